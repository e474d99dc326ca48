"""Chat formatting with a grammar round trip.

A conversation is rendered as turns ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. A
deterministic parser reads the rendered text back; its grammar has no control
string inside a role or text, so it refuses one that was left there. Where it
refuses, or recovers something else than the source, the offending part is
escaped and rendered again until both are identical. Escaping adds one backslash
after ``<`` in every run ``<``, backslashes, ``|``; the parser takes one away, so
nothing is ambiguous and no control string is left.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str]]:
    """Turns of a rendered text; raises ValueError where it isn't in the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1)
        if line < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} does not end")
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in role or END in role or START in text:
            raise ValueError(f"a control string inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text)))
        at = end + len(END) + 1
    return turns


def _round_trips(rendered: str, role: str, text: str) -> bool:
    try:
        return parse(rendered) == [(role, text)]
    except ValueError:
        return False


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering, and where its text begins and ends in it."""
    for name, body in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        rendered = f"{START}{name}\n{body}{END}\n"
        if _round_trips(rendered, role, text):
            begin = len(START) + len(name) + 1
            return rendered, begin, begin + len(body)
    raise AssertionError("the escape is not reversible")


_PARTS = "_id {id}, part long, turns long, formatted string, spans array<struct<begin:int,end:int>>"


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = 1 << 20, trained_role: str = "assistant") -> DataFrame:
    """``_id, part, turns, formatted, spans``: rendered conversations, with the spans under the loss mask.

    Rows of a conversation go in order of turn (null first), then role and text,
    so ties and repeated rows keep one order and each is a turn. A null role or
    text counts as empty; rows with a null conversation id form one
    conversation. A conversation is one part unless it is longer than
    ``part_chars``: then parts end between turns, and a long conversation streams
    through its task without being held. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role_col, "_role"), (text_col, "_text"))))

    def render(batches):
        state = {"id": None, "any": False, "part": 0}
        body, spans, length = [], [], 0

        def parts(more: bool):
            nonlocal body, spans, length
            if body:
                yield {"_id": state["id"], "part": state["part"], "turns": len(body), "formatted": "".join(body), "spans": spans}
            body, spans, length = [], [], 0
            state["part"] = state["part"] + 1 if more else 0

        for batch in batches:
            out = []
            ids, roles, texts = (batch.column(c).to_pylist() for c in ("_id", "_role", "_text"))
            for key, role, text in zip(ids, roles, texts, strict=True):
                if not state["any"] or key != state["id"]:
                    out += parts(False)
                    state["id"], state["any"] = key, True
                rendered, a, b = render_turn(role, text)
                if body and length + len(rendered) > part_chars:
                    out += parts(True)
                if role == trained_role:
                    spans.append({"begin": length + a, "end": length + b})
                body.append(rendered)
                length += len(rendered)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        last = list(parts(False))
        if last:
            yield pa.RecordBatch.from_pylist(last, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = rows.schema["_id"].dataType.simpleString()
    ddl = _PARTS.format(id=kind)
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    ordered = rows.repartition("_id").sortWithinPartitions("_id", F.col("_turn").asc_nulls_first(), "_role", "_text")
    return ordered.mapInArrow(render, ddl)


def digest_chats(parts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``<id_col>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation, read back from rendered parts in the order in which :func:`format_chats` returns them (a table doesn't keep it: digest parts before they are written, or sort them again).

    Turns are those of the parser, unescaped; the loss text is what the spans
    hold, unescaped, one after the other. An empty turn adds its role and two
    line feeds to the turns' digest and nothing to the loss; a conversation
    without a trained turn has the digest of the empty string. Repeated rows are
    turns of their own, as they were rendered. Rows with a null id are one
    conversation. No parts give an empty result.
    """
    kind = parts.schema["_id"].dataType.simpleString()
    names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, some = None, False
        out: dict = {n: [] for n in names}

        def close():
            for n, v in zip(names, (now, turns, whole.hexdigest(), chars, loss.hexdigest(), size), strict=True):
                out[n].append(v)

        for batch in batches:
            out = {n: [] for n in names}
            for row in batch.to_pylist():
                if not some or row["_id"] != now:
                    if some:
                        close()
                    now, some, turns, chars, size, whole, loss = row["_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse(row["formatted"]):
                    whole.update(f"{role}\n{text}\n".encode())
                    turns += 1
                for span in row["spans"]:
                    text = unescape(row["formatted"][span["begin"] : span["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                size += len(row["formatted"])
            yield pa.RecordBatch.from_arrays([pa.array(out["_id"], batch.column("_id").type), *(pa.array(out[n], pa.string() if "sha" in n else pa.int64()) for n in names[1:])], names)
            id_type = batch.column("_id").type
        if some:
            out = {n: [] for n in names}
            close()
            yield pa.RecordBatch.from_arrays([pa.array(out["_id"], id_type), *(pa.array(out[n], pa.string() if "sha" in n else pa.int64()) for n in names[1:])], names)

    digests = parts.mapInArrow(run, f"_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return digests.withColumnRenamed("_id", id_col)
