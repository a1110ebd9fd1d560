"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_folder

TREES, DEPTH = 60, 8
#: The forest is fitted on at most so many labelled findings, the first by a hash of the value.
MAX_FINDINGS = 20_000
#: Words of the dictionary, and parts of a candidate compared with it, have so many letters.
SHORTEST, LONGEST = 4, 10
#: Kinds of findings in the labelled table.
KINDS = 29
#: Characters on either side of a candidate in which its neighbouring words are sought.
NEAR = 80

# Names that secrets are assigned to.
_NAMES = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential"
# A run starts where none of its characters stands before, so every search goes through a run once.
_START = r"(?<![A-Za-z0-9+/_=-])"
# A run with such a name in it, up to the sign of an assignment and the quote behind it.
_HEAD = (
    rf"(?i:(?>[A-Za-z0-9+/_=-]*?({_NAMES}))[A-Za-z0-9+/_-]*+[\"'\]]{{0,2}}\s{{0,3}}[=:]{{1,2}}+>?\s{{0,3}}[\"']?)"
    r"(?=[^\s\"'<>]{6})"
)
# Runs long enough for a secret: with a digit, with both cases beyond a first capital, or of a known form.
_MIXED = r"[A-Za-z0-9+/_=-][a-z+/_=-]*+[A-Z]"
_RUN = rf"(?=[A-Za-z+/_=-]*+[0-9]|(?={_MIXED})[A-Z+/_=-]*+[a-z]|AKIA[A-Z]{{16}})[A-Za-z0-9+/_=-]{{16,}}"
CANDIDATE = rf"{_START}(?:{_HEAD}[^\s\"'<>]+|{_RUN})"
_ASSIGNED = rf"^{_HEAD}"
_SECRET_WORD = rf"(?i)({_NAMES}|bearer|akia|login|credentials?)"
_OTHER_WORD = r"(?i)(commit|sha\d*|md5|checksum|digest|hash|uuid|order|invoice|card|phone|isbn|issue|version|page|figure|example|sample)"
_TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"

FEATURES = [
    "length", "transitions", "distinct", "digits", "uppers", "vowels", "hexadecimal", "separators", "coverage",
    "assigned", "secret_word", "other_word", "test_path", "repeats",
]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.lit(1), F.length(value))


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """(doc_id, text_hash, place, start, length, value, name, before, after, path) of every candidate.

    `start` and `length` are in characters of the text and cover the value without the name that it
    is assigned to. Only texts with a candidate are cut up; rows equal in doc_id, text and path are
    one.
    """
    found = (
        docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), path.cast("string").alias("path"))
        .where(F.col("text").rlike(CANDIDATE))
        .select(
            "doc_id", F.xxhash64("text").alias("text_hash"), "path",
            F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
            F.split("text", CANDIDATE, -1).alias("between"),
        )
    )
    # What stands before each candidate, the candidate, and what stands after it.
    each = found.select(
        "doc_id", "text_hash", "path",
        F.posexplode(
            F.arrays_zip(
                F.transform("between", lambda x: F.length(x)).alias("gap"),
                F.transform("between", lambda x: F.right(x, F.lit(NEAR))).alias("left"),
                F.col("found").alias("value"),
                F.transform(F.slice("between", F.lit(2), F.size("between")), lambda x: F.left(x, F.lit(NEAR))).alias("right"),
            )
        ).alias("place", "x"),
    ).select("doc_id", "text_hash", "path", "place", "x.gap", "x.left", "x.value", "x.right").where("value IS NOT NULL").distinct()
    earlier = Window.partitionBy("doc_id", "text_hash", "path").orderBy("place")
    before_it = F.sum(F.col("gap") + F.length("value")).over(earlier) - F.length("value")
    head = F.regexp_extract("value", _ASSIGNED, 0)
    return each.withColumn("whole_start", before_it).select(
        "doc_id", "text_hash", "path", "place",
        (F.col("whole_start") + F.length(head)).alias("start"),
        (F.length("value") - F.length(head)).alias("length"),
        F.expr("substring(value, 1)").alias("matched"), head.alias("head"), "left", "right",
    ).select(
        "doc_id", "text_hash", "path", "place", "start", "length",
        F.substring(F.col("matched"), F.length("head") + 1, F.col("length")).alias("value"),
        F.regexp_extract("matched", _ASSIGNED, 1).alias("name"),
        F.regexp_extract("left", r"(\S+)\s*$", 1).alias("before"),
        F.regexp_extract("right", r"^[\"']?\s*(\S+)", 1).alias("after"),
    )


def dictionary(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(word): whole lower-case words of a vocabulary file of the tokenizers library.

    As many rows at most as the file has entries, whatever the data.
    """
    with open(vocabulary, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    whole = re.compile(rf"([a-z]{{{SHORTEST},{LONGEST}}})</w>")
    return spark.createDataFrame(sorted((m[1],) for m in map(whole.fullmatch, entries) if m), "word string")


def _coverage(found: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coverage): share of a value's characters that lie in words of the dictionary."""
    lower = F.lower("value")
    parts = found.select(
        *keys, lower.alias("value"), F.explode(F.sequence(F.lit(SHORTEST), F.lit(LONGEST))).alias("n")
    ).where(F.length("value") >= F.col("n")).select(
        *keys, "value", "n", F.explode(F.expr("sequence(1, length(value) - n + 1)")).alias("at")
    ).select(*keys, F.length("value").alias("size"), "at", "n", F.expr("substring(value, at, n)").alias("word"))
    inside = parts.where(F.col("word").rlike("^[a-z]+$")).join(F.broadcast(words), "word")
    places = inside.select(*keys, "size", F.explode(F.expr("sequence(at, at + n - 1)")).alias("covered")).distinct()
    return places.groupBy(*keys, "size").agg(F.count("*").alias("n")).select(*keys, (F.col("n") / F.col("size")).alias("coverage"))


def finding_features(found: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """The findings with FEATURES, from (value, name, before, after, path)."""
    value = F.col("value")
    around = F.concat_ws(" ", "name", "before", "after")
    measured = found.withColumns({
        "length": F.log1p(F.length(value)).cast("double"),
        "transitions": _share(value, r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.lit(1), F.length(value)),
        "digits": _share(value, "[0-9]"),
        "uppers": _share(value, "[A-Z]"),
        "vowels": _share(value, "[aeiouAEIOU]"),
        "hexadecimal": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "separators": _share(value, "[-_/=+]"),
        "repeats": _share(value, r"(.)(?=\1)"),
        "assigned": (F.col("name") != "").cast("double"),
        "secret_word": (around.rlike(_SECRET_WORD) | value.rlike("(^|[^A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{36})$")).cast("double"),
        "other_word": around.rlike(_OTHER_WORD).cast("double"),
        "test_path": F.coalesce(F.col("path").rlike(_TEST_PATH), F.lit(False)).cast("double"),
    })
    covered = _coverage(found, words, keys)
    same = covered.select(*(F.col(k).alias(f"of_{k}") for k in keys), "coverage")
    on = [measured[k].eqNullSafe(same[f"of_{k}"]) for k in keys]
    joined = measured.join(same, on, "left").drop(*(f"of_{k}" for k in keys))
    return joined.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def labelled_findings(spark: SparkSession, vocabulary: str, each: int = 60) -> DataFrame:
    """(finding, value, name, before, after, path, secret): a labelled table, made by rule.

    For every kind of finding, `each` values from a digest of their number; `finding` modulo KINDS is
    the kind. Secrets are keys and passwords under names for them, and keys of a known form; the others
    are what is mistaken for such: digests, card and order numbers, identifiers, paths, file names, words
    with numbers, placeholders.
    """
    words = [r.word for r in dictionary(spark, vocabulary).limit(4000).collect()]
    rows = []
    names = ["token", "secret", "password", "api_key", "access_key", "passwd"]
    text = ["the", "of", "in", "see", "with", ""]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = "abcdefghijklmnopqrstuvwxyz"
    both = letters + letters.upper()
    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    for k in range(each):
        digest = hashlib.sha256(f"finding {k}".encode()).digest()
        raw, a, b = digest.hex(), words[k * 61 % len(words)], words[(k * 89 + 7) % len(words)]
        c, bare = words[(k * 53 + 11) % len(words)], "".join(both[x % 52] for x in digest)
        long = "".join(mixed[x % len(mixed)] for x in digest)
        name, near, far = names[k % 6], text[k % 6], text[k * 5 % 6]
        path = ["src/app", "conf", "src0", "src7", "deploy"][k % 5]
        made = [
            (raw[:40], name, near, far, path, 1), (raw[:18], name, near, far, path, 1), (long, name, near, far, path, 1),
            ("AKIA" + "".join(upper[x % 32] for x in digest[:16]), "", near, far, path, 1),
            (raw[:40].upper(), name, near, far, path, 1), (long[:24], name, near, far, path, 1),
            (raw[:40], "", "commit", far, path, 0), (raw[:32], "", "md5", far, path, 0), (raw, "", "sha256", far, path, 0),
            (str(int(raw[:14], 16))[:16].zfill(16), "", near, far, path, 0),
            (f"{a}-{b}-{k}", "", near, far, path, 0), (f"{a}/{b}/page{k}", "", near, far, path, 0),
            (f"{a}_{b}_v{k}", "", "version", far, path, 0), (f"{raw[:8]}-{raw[8:12]}-{raw[12:16]}-{raw[16:20]}-{raw[20:32]}", "", "uuid", far, path, 0),
            (f"your_{a}_here{k}", name, near, far, "docs/example", 0), ("x" * (16 + k % 9) + "1", name, near, far, "tests/sample", 0),
            (f"{a}{b.title()}{k}", "", near, far, path, 0), ("=" * (15 + k % 30) + "1", "", near, far, path, 0),
            (f"{a}.{b}", name, near, far, path, 0),
            # Without a digit.
            ("AKIA" + "".join(letters[x % 26] for x in digest[:16]).upper(), "", near, far, path, 1),
            ("ghp_" + bare + bare[:4], "", near, far, path, 1), (bare, name, near, far, path, 1),
            (f"{a}-{b}", name, near, far, path, 1),
            (f"{a}{b.title()}{c.title()}", "", near, far, path, 0), (f"{a.title()}{b.title()}{c.title()}", "", near, far, path, 0),
            (f"/{a}/{b}/{c.title()}/{a.title()}{b.title()}", "", near, far, path, 0), (f"{a}-{b.title()}-{c}", "", near, far, path, 0),
            # Behind paths and long names.
            (f"/{a}/{b}/{c}/{b}/{a}/AKIA" + "".join(upper[x % 32] for x in digest[:16]), "", near, far, path, 1),
            (f"/{a}/{b}/{c}/{b}/{a}/{c}{k}", "", near, far, path, 0),
        ]
        rows += [(KINDS * k + j, *row) for j, row in enumerate(made)]
    return spark.createDataFrame(rows, "finding long, value string, name string, before string, after string, path string, secret int")


def fit_secret_model(
    findings: DataFrame, words: DataFrame, max_findings: int = MAX_FINDINGS, seed: int = 11
) -> RandomForestClassificationModel:
    """Random forest on FEATURES, from findings with a key `finding` and `secret` 0 or 1."""
    known = findings.where("secret IN (0, 1)").orderBy(F.xxhash64("value", "finding")).limit(max_findings)
    table = finding_features(known, words, ["finding"])
    vectors = _vectors(table).select("finding_vector", F.col("secret").cast("double").alias("label")).coalesce(1).persist()
    try:
        return RandomForestClassifier(
            featuresCol="finding_vector", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt"
        ).fit(vectors)
    finally:
        vectors.unpersist()


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="finding_vector", handleInvalid="keep").transform(found)


def scan_secrets(
    docs: DataFrame,
    model: RandomForestClassificationModel,
    words: DataFrame,
    path: Column,
    threshold: float = 0.5,
) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret): every candidate of every text, judged.

    Candidates are values assigned to names such as token or password, the names in quotes or part of
    longer ones too, and long runs of letters, digits and a few signs that have a digit, both cases, or
    the form of an access key. Finding them takes time in proportion to the text, whatever its runs. The
    forest scores them by length, character
    transitions, dictionary coverage, the words around them and `path`, a column that says where the
    text comes from; `is_secret` if the score is `threshold` or more.

    Places are in characters. Null and empty texts have no candidate. Very long candidates are
    judged whole. Rows that are equal in doc_id, text and path give their findings once; a null
    doc_id is carried along, a null path is no test path. Other columns are not read. An empty table
    gives no rows. Only candidates are shuffled.
    """
    shared_folder(docs.sparkSession)
    keys = ["doc_id", "text_hash", "path", "place"]
    found = candidates(docs, path).checkpoint()
    scored = model.transform(_vectors(finding_features(found.withColumnRenamed("length", "n_chars"), words, keys)))
    score = vector_to_array(F.col("probability"))[1]
    return scored.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("n_chars").cast("long").alias("length"), "value",
        score.alias("score"), (score >= threshold).alias("is_secret"),
    )
