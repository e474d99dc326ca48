"""Text, hash and JSON functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

#: Source labels of causes and the taxonomy's category and subcategory (fixed values).
CAUSES = {
    "malveillance": ("human_known", "malicious"),
    "accidentelle": ("human_known", "accident_unspecified"),
    "involontaire (travaux)": ("human_known", "work_activity"),
    "involontaire (particulier)": ("human_known", "private_activity_negligence"),
    "naturelle": ("natural_known", "natural_unspecified"),
    "inconnue": ("unknown", "unknown_unspecified"),
}

#: Domains whose pages count as authority, established press and community signals, and label beginnings of fire services.
AUTHORITY = ["gouv.fr", "santepubliquefrance.fr", "onf.fr"]
AUTHORITY_LABELS = ["sdis", "pompiers"]
PRESS = [
    "20minutes.fr", "actu.fr", "bfmtv.com", "dna.fr", "estrepublicain.fr", "francebleu.fr", "francetvinfo.fr", "ici.fr", "ladepeche.fr", "lardennais.fr",
    "ledauphine.com", "lefigaro.fr", "lindependant.fr", "lemonde.fr", "midilibre.fr", "ouest-france.fr", "republicain-lorrain.fr", "sudouest.fr", "tf1info.fr",
]
COMMUNITY = ["feuxdeforet.fr"]


def json_number(payload: Column, key: str) -> Column:
    """A number or numeric string of a JSON object; null for anything else."""
    return F.get_json_object(payload, f"$.{key}").try_cast("double")


def fold_text(text: Column) -> Column:
    """Lower case, without accents, every run of other characters as one space."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def contains_words(haystack: Column, needle: Column) -> Column:
    """Whether the folded needle stands in the folded haystack as whole words; never for an empty needle."""
    h, n = fold_text(haystack), fold_text(needle)
    return (F.length(n) > 0) & F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def valid_commune_code(code: Column) -> Column:
    """Five characters: digits, or 2A or 2B and three digits."""
    return F.coalesce(code.rlike("^([0-9]{5}|2[AB][0-9]{3})$"), F.lit(False))


def department_code(code: Column) -> Column:
    """Two characters, three for overseas codes; null for invalid codes."""
    return F.when(valid_commune_code(code), F.when(code.startswith("97"), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2)))


def row_checksum(*parts: Column) -> Column:
    """SHA-256 over the parts as text, joined by a bar; nulls are written as a tilde."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts)), 256)


def fingerprint(df: DataFrame, key: str, checksum: str) -> DataFrame:
    """One order-independent digest of a table: the sums of four 60-bit words of every row's digest, and the number of rows, hashed. Each row adds to sums only, so no task holds more than its rows."""
    digest = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.col(checksum)), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    t = df.agg(*(F.coalesce(F.sum(w).cast("decimal(38,0)"), F.lit(0)).cast("string").alias(f"w{k}") for k, w in enumerate(words)), F.count("*").alias("rows"))
    return t.select(F.sha2(F.concat_ws(":", "w0", "w1", "w2", "w3", F.col("rows").cast("string")), 256).alias("fingerprint"), "rows")


def hash_order(seed: str, *parts: Column) -> Column:
    """A deterministic pseudo-random sort key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)))


def map_cause(label: Column) -> Column:
    """``(category, subcategory)`` of a source label; unmapped labels are indeterminate, blank ones null."""
    text = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
    of = lambda category, sub: F.struct(F.lit(category).alias("category"), F.lit(sub).alias("subcategory"))
    known = F.create_map(*(x for name, pair in CAUSES.items() for x in (F.lit(name), of(*pair))))  # the text is made once, not once a name
    return F.when(F.coalesce(text, F.lit("")) != "", F.coalesce(F.try_element_at(known, text), of("indeterminate", "unmapped")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)https?://([^/:?#]+)", 1))


def domain_class(url: Column, authority: list[str] | None = None, press: list[str] | None = None, community: list[str] | None = None) -> Column:
    """``authority``, ``press``, ``community`` or ``other``, by the host or a parent domain of it."""
    host = host_of(url)
    of = lambda names: host.rlike("(^|\\.)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$")
    service = host.rlike("(^|\\.)(" + "|".join(AUTHORITY_LABELS) + ")")
    return F.when(of(authority or AUTHORITY) | service, "authority").when(of(press or PRESS), "press").when(of(community or COMMUNITY), "community").otherwise("other")


def canonical_url(url: Column) -> Column:
    """Scheme, lower-case host and path, without query, fragment and closing slashes; null for other schemes."""
    scheme, path = F.lower(F.regexp_extract(url, "^(?i)(https?)://", 1)), F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host_of(url), F.regexp_replace(path, "/+$", "")))
