"""Secret scans by corpus-wide ownership frequency.

Candidates are found by pattern in the whole text of every document. Each distinct value (by its SHA-256) is counted
over the distinct owners and repositories that hold it. A value that many owners hold, or several owners in many repositories, is
an example that people copied, and so is one that says itself that it stands for another; one that few hold is taken for a live
credential of theirs. The documents table has no repository or owner columns:
by default the owner is the source, and the repository is the source and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from granary.sources.tables import written

from .common import fresh, need

#: A value that at least this many owners hold is an example; one that several hold also from this many repositories on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 4, 8
#: Values that stand for a secret, in the syntax that Java and RE2 share; held against the value in lower case.
PLACEHOLDER = "^[^a-z0-9]*(your|my|some|the)[^a-z]|example|placeholder|change.?me|redacted|dummy|x{6,}|<[^>]*>|[$][{]|[{][{]"
#: Every candidate has one of these, in any case. One pass of an automaton looks for all of them, far cheaper than the patterns.
STEMS = "(?i)token|secret|api[_-]?key|access[_-]?key|passw|passphrase|pwd|bearer|authorization|-----begin |akia|gh[pousr]_|github_pat_|xox[abprs]-|eyj|[sr]k_(?:live|test)_"
#: The forms that the SQL knows; these patterns mean the same to Java and RE2. The operators use FORMS.
KINDS = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*",
    "access_key": "AKIA[0-9A-Z]{16}",
    "code_host": "gh[pousr]_[A-Za-z0-9]{36}",
    "chat": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    "assigned": "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY|[Pp]assword|PASSWORD|[Pp]asswd)[\"']?\\s*[=:]\\s*[\"']?[A-Za-z0-9_+/.-]{8,}",
}
PATTERN = "(" + "|".join(KINDS.values()) + ")"
#: What comes before the value in an assignment.
LEAD = "^[A-Za-z_]+[\"']?\\s*[=:]\\s*[\"']?"
MASK = "[SECRET]"
_BEGIN, _END = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", "-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: What may stand between the key word and the value: more of the name, and the sign of the assignment.
_ASSIGN = "[A-Za-z0-9_-]*+\\\\?[\"']?\\s*(?::=|=>|[=:])\\s*"
#: (kind, pattern of the whole candidate) in Java's syntax. Repeated groups are possessive: these take no stack, however long a text is.
FORMS = KINDS | {
    # To the END line, whatever is between; where there is none, as far as lines of a key go.
    "private_key": _BEGIN + "(?:[^-]*+(?:-{1,4}+[^-]++)*+" + _END + "|(?:[A-Za-z0-9+/=\\s]|\\\\[nr]|(?<![A-Za-z])(?:Proc-Type|DEK-Info):[^\\r\\n\\\\]*+)*+)",
    "code_host": "(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})",
    "payment": "[sr]k_(?:live|test)_[A-Za-z0-9]{10,}",
    # A JSON web token is found as such also in a header.
    "bearer": "(?:[Aa]uthorization|AUTHORIZATION)\\\\?[\"']?\\s*[:=]\\s*\\\\?[\"']?(?i:bearer|basic|token)\\s+(?!" + KINDS["jwt"] + ")[A-Za-z0-9._~+/=-]{8,}|(?:[Bb]earer|BEARER)\\s+(?!" + KINDS["jwt"] + ")[A-Za-z0-9._~+/=-]{20,}",
    # In quotes all up to the closing one; else up to a space, a quote or an escaped line break, where that is more than a word of prose.
    # A key is left to private_key.
    "assigned": "[TtSsAaPp](?i:(?<=t)oken|(?<=s)ecret|(?<=a)pi[_-]?key|(?<=a)ccess[_-]?key|(?<=p)assw(?:or)?d|(?<=p)assphrase|(?<=p)wd)" + _ASSIGN + "(?!\\\\?[\"'`]?-----BEGIN )"
    + "(?:\"(?:[^\"\\\\\\r\\n]|\\\\[^\\r\\n]){8,}+\"|'(?:[^'\\\\\\r\\n]|\\\\[^\\r\\n]){8,}+'|`[^`\\r\\n]{8,}+`|\\\\\"[^\"\\\\\\r\\n]{8,}+\\\\\"|\\\\?[\"'`]?(?=[^\\s\"'`]*(?:[0-9!#$%&*+/=?@^~|]|[a-z][A-Z]))(?:[^\\s\"'`\\\\]|\\\\(?![nrt\"'])){8,}+)",
}
FORM = "(" + "|".join(FORMS.values()) + ")"


def _flagged(df: DataFrame, text: str, flag: str, only: bool = False) -> DataFrame:
    """``df`` with a column ``flag``: whether the text can hold a candidate at all; ``only`` such rows."""
    at = df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = StructType([*plain.schema.fields, StructField(flag, BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = pc.fill_null(pc.match_substring_regex(b.column(at), STEMS), False)
            out = pa.RecordBatch.from_arrays([*b.columns, may], schema.names)
            yield out.filter(may) if only else out

    return plain.mapInArrow(run, schema).toDF(*df.columns, flag)


def candidates(text: Column) -> Column:
    """All candidates in a text, in order, with repeats; null for null."""
    return F.regexp_extract_all(text, F.lit(FORM), F.lit(1))


def _value(c: str = "candidate") -> Column:
    """The secret in a candidate: without the name and the quotes of an assignment, or the punctuation after it where there are none."""
    c = F.col(c)
    header = F.regexp_extract(c, "(\\S+)$", 1)
    inner = F.regexp_replace(c, "^[A-Za-z]" + _ASSIGN + "\\\\?[\"'`]?", "")
    value = F.when(c.rlike("[\"'`]$"), F.regexp_replace(inner, "\\\\?[\"'`]$", "")).otherwise(F.regexp_replace(inner, "[,;)\\]}>]+$", ""))
    return F.when(c.rlike("^(?:" + "|".join(v for k, v in FORMS.items() if k not in ("assigned", "bearer")) + ")"), c).when(c.rlike("^(?:" + FORMS["bearer"] + ")"), header).otherwise(value)


def _hash(value: str = "value") -> Column:
    """SHA-256 of a value; of a private key that of its body without line breaks, so that one key has one hash however it is written."""
    v = F.col(value)
    body = F.regexp_replace(F.regexp_replace(v, f"^{_BEGIN}|{_END}$", ""), "\\\\[nr]|\\s", "")
    return F.sha2(F.when(v.startswith("-----BEGIN") & (body != ""), body).otherwise(v), 256)


def _kind(c: str = "candidate") -> Column:
    k = F.lit("assigned")
    for name in reversed([n for n in FORMS if n != "assigned"]):
        k = F.when(F.col(c).rlike("^(?:" + FORMS[name] + ")"), F.lit(name)).otherwise(k)
    return k


def findings(df: DataFrame, key: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, owner, repository, kind, value, hash, n) of every distinct candidate of every row of ``df``."""
    need(df, key, text, *(["source"] if owner is None or repository is None else []), *(["lang"] if repository is None else []))
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if repository is None else repository
    plain = df.select(F.col(key).alias("doc_id"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), F.col(text).alias("text"))
    found = _flagged(plain, "text", "flag", only=True).select("doc_id", "owner", "repository", F.explode(candidates(F.col("text"))).alias("candidate"))
    found = found.withColumn("kind", _kind()).withColumn("value", _value())
    return found.groupBy("doc_id", "owner", "repository", "kind", "value").agg(F.count("*").alias("n")).withColumn("hash", _hash())


def _hashed(found: DataFrame) -> DataFrame:
    """A table of ``findings``, written down without the values: what is used twice is found once."""
    stands = F.lower("value").rlike(PLACEHOLDER) & F.col("kind").isin("assigned", "bearer")
    return written(found.select("doc_id", "owner", "repository", "kind", "hash", "n", stands.alias("placeholder")))


def verdicts(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(hash, documents, repositories, owners, verdict) of every distinct value of a table as ``_hashed`` gives it."""
    counts = found.groupBy("hash").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.max("placeholder").alias("placeholder"))
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories)) | F.col("placeholder")
    return counts.select("hash", "documents", "repositories", "owners", F.when(copied, "example").otherwise("live").alias("verdict"))


def scan_secrets(df: DataFrame, example_owners: int = EXAMPLE_OWNERS, key: str = "doc_id", text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, kind, hash, n, documents, repositories, owners, verdict): one row for each distinct value in a document.

    The value itself is neither returned nor written. Null, empty and very long texts are scanned whole; nulls and empty texts find
    nothing. Null owners and repositories count as one named ''. A null key is reported but is no document of the count.
    Repeated rows add to n only. Ties need no rule: a value has one verdict everywhere. An empty table gives no rows.
    """
    found = _hashed(findings(df, key, text, owner, repository))
    rows = found.groupBy("doc_id", "kind", "hash").agg(F.sum("n").alias("n"))
    return rows.join(verdicts(found, example_owners), "hash").select("doc_id", "kind", "hash", "n", "documents", "repositories", "owners", "verdict")


def redact_secrets(df: DataFrame, example_owners: int = EXAMPLE_OWNERS, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """All rows of ``df`` with every live value in the text replaced by [SECRET]; examples stay.

    ``n_chars`` becomes the length of the new text where that changed. Only rows that hold a candidate are joined with
    the verdicts; the others pass from the scan to the result. Nulls, empty tables and repeated rows: as in ``scan_secrets``;
    every row stays.
    """
    live = verdicts(_hashed(findings(df, key, text)), example_owners).where("verdict = 'live'").select("hash")
    flag = fresh(df, "_s_flag")
    flagged = _flagged(df, text, flag)
    has = F.when(F.col(flag), F.col(f"`{text}`").rlike(FORM)).otherwise(F.lit(False))
    row = fresh(df, "_s_row")
    dirty = flagged.where(has).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)).withColumn("_s_id", F.monotonically_increasing_id())
    held = dirty.select("*", F.explode(F.array_distinct(candidates(F.col(row)[text]))).alias("candidate")).withColumn("value", _value()).withColumn("hash", _hash())
    # A row's own spellings are masked, the longest first, as one may be a part of another.
    own = F.when(F.col("_s_live"), F.struct(F.length("value").alias("length"), "value"))
    held = held.join(live.withColumn("_s_live", F.lit(True)), "hash", "left").groupBy("_s_id").agg(F.first(row).alias(row), F.sort_array(F.collect_set(own), asc=False).alias("_s_values"))
    masked = F.aggregate("_s_values", F.col(row)[text], lambda t, v: F.replace(t, v["value"], F.lit(MASK)))
    out = held.withColumn("_s_text", masked)
    columns = []
    for c in df.columns:
        old = F.col(row)[c]
        if c == text:
            old = F.col("_s_text")
        elif c == n_chars:
            old = F.when(F.col("_s_text") != F.col(row)[text], F.length("_s_text").cast(df.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return flagged.where(~has).drop(flag).unionByName(out.select(*columns))


_Q = PATTERN.replace("'", "''")
SCAN_SQL = f"""WITH c AS (
  SELECT doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, unnest(regexp_extract_all(text, '{_Q}', 1)) AS candidate FROM documents
), k AS (
  SELECT *, CASE {" ".join(f"WHEN regexp_matches(candidate, '^{KINDS[k].replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k in KINDS if k != "assigned")} ELSE 'assigned' END AS kind,
    CASE WHEN regexp_matches(candidate, '^(AKIA|gh[pousr]_|xox|eyJ|-----)') THEN candidate ELSE regexp_replace(candidate, '{LEAD.replace(chr(39), chr(39) * 2)}', '') END AS value FROM c
), f AS (SELECT *, sha256(value) AS hash, kind = 'assigned' AND regexp_matches(lower(value), '{PLACEHOLDER}') AS placeholder FROM k),
v AS (SELECT hash, count(DISTINCT doc_id) AS documents, count(DISTINCT repository) AS repositories, count(DISTINCT owner) AS owners, bool_or(placeholder) AS placeholder FROM f GROUP BY hash)
SELECT doc_id, kind, hash, count(*) AS n, documents, repositories, owners, CASE WHEN owners >= {EXAMPLE_OWNERS} OR owners > 1 AND repositories >= {EXAMPLE_REPOSITORIES} OR v.placeholder THEN 'example' ELSE 'live' END AS verdict
FROM f JOIN v USING (hash) GROUP BY ALL"""
