"""Licence scan by canonical digests [native].

A text is brought to a canonical form: A-Z to lower case, punctuation and white space to single
spaces, lines of copyright ownership removed, equivalent spellings unified. The SHA-256 of the
form is the key of a hash join with the digests of known licence texts. Two units are looked
up: the entire document, and every line as a text of its own against one-line notices.

All of it is DataFrame functions over whole texts. The known digests are a fixed list (under a
kilobyte each way), so Spark broadcasts them; only lines and documents that match are shuffled,
and a notice that a third of all documents carry costs a row per document.

Defined cases: null or empty text, and text of nothing but punctuation or copyright lines, has
an empty form and matches nothing; rows that repeat are reported alike; a null doc_id is
reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: characters that count as punctuation beyond ASCII, and spellings that licence
# matching guidelines treat as equivalent
MARKS = " ‘’“”–—…•"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPELLINGS = [
    (r"licenc(e|es|ed|ing|ee|or)( |$)", r"licens$1$2"),
    (r"(author|organ|recogn|util|capital|general|initial)is(e|es|ed|ing|ation)( |$)", r"$1iz$2$3"),
    (r"(behavi|fav|hon|lab)our", r"$1or"),
    (r"copyright owner", "copyright holder"),
    (r"non (commercial|infringement|exclusive)", r"non$1"),
    (r"sub licens", "sublicens"),
    (r"per cent", "percent"),
]
#: A line of ownership: copyright, its sign, or a year or holder after either.
OWNERSHIP = r"^(portions )?(copyright( c)?( ©)?( [0-9]{4}| by |$)|copyright c |copyright ©|c [0-9]{4}|© ?[0-9]{4}|© )"


def canonical_line(line: Column) -> Column:
    out = F.translate(F.translate(line, UPPER, LOWER), MARKS, " " * len(MARKS))
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for pattern, by in SPELLINGS:
        out = F.regexp_replace(out, pattern, by)
    return out


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that say something besides ownership."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(OWNERSHIP) & (x != "all rights reserved"))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """license, digest of a list of (identifier, text)."""
    rows = spark.createDataFrame(texts, "license string, text string")
    digest = F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256)
    return rows.select(digest.alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, licenses: list[tuple[str, str]], notices: list[tuple[str, str]],
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, digest (canonical, of the entire text), license (of the entire text,
    or null), notices (identifiers of its notice lines, sorted, comma-joined), n_notices."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("doc_id", F.xxhash64("text").alias("key"), canonical_lines(F.col("text")).alias("lines"))
    whole = lines.select("doc_id", "key", F.sha2(F.array_join("lines", " "), 256).alias("digest"))
    said = (lines.select("doc_id", "key", F.explode(F.array_distinct("lines")).alias("line"))
            .select("doc_id", "key", F.sha2("line", 256).alias("digest"))
            .join(known_digests(spark, [*licenses, *notices]), "digest")
            .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license")).alias("found")))
    entire = known_digests(spark, [*licenses, *notices])
    joined = whole.join(entire, "digest", "left").alias("w").join(
        said.alias("s"), F.col("w.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("w.key").eqNullSafe(F.col("s.key")),
        "left")
    return joined.select("w.doc_id", "w.digest", "w.license",
                         F.coalesce(F.array_join("s.found", ","), F.lit("")).alias("notices"),
                         F.coalesce(F.size("s.found"), F.lit(0)).cast("bigint").alias("n_notices"))
