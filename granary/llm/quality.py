"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a histogram of fixed buckets: two sketches merge by adding counts, in any order and on any number of
partitions, and a quantile read from one is at most a bucket's width (WIDTH) too low. Each rule measures a share of
the text per mille (or a mean). Its own threshold in a group is median + FENCE * max(upper quartile - median, least spread), read from
the group's sketch. Small groups know little of themselves: a language's threshold is the mean of its own, weighted by its
documents, and that of all languages, weighted as PRIOR documents; a group's that of its own and of its language's, in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import cut_lineage, fresh, join_small, need, span_hashes, spans, text_bytes, text_slices

#: Width of a bucket, per mille.
WIDTH = 2
FENCE = 8
#: Documents that the threshold of the next wider group weighs as much as.
PRIOR = 40
#: Characters, words and lines that are added to the length, so that one odd token in a very short text weighs little.
PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES = 100, 20, 5
#: Characters of a word that the added words have.
PRIOR_LENGTH = 5
SYMBOLS = "*$&%#!|<>{}[]\\/=+_~^@"
UPPER = "[^A-ZÀ-ÖØ-Þ]+"
BULLETS = "-*+#>"
#: Least spread of each rule.
RULES = {"symbols": 4, "capitals": 20, "repeats": 20, "digits": 30, "word_length": 10, "line_repeats": 50, "bullets": 50, "ellipses": 50}

_SPACE, _SYMBOL, _CAPITAL, _DIGIT, _BULLET = (np.isin(np.arange(256), list(x.encode())) for x in (" \t\n\r\f", SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", BULLETS))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The value of every rule for each text, -1 where a text is null or blank. Words are what white space (of ASCII) sets apart, lines what isn't blank between line breaks."""
    data, offsets = text_bytes(texts)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    rows = len(texts)
    space = _SPACE[data]
    starts, ends = spans(~space, offsets)
    chars = per_row((data & 0xC0) != 0x80)
    word_row = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(word_row, minlength=rows)
    h = span_hashes(data, starts, ends)
    same = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    repeats = np.bincount(word_row[1:][same], minlength=rows)
    letters = chars - per_row(space)
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lo, hi = spans(data != 10, offsets)
    # Of each line the first byte that is no white space; blank lines have none.
    first = np.searchsorted(starts, lo)
    full = np.append(starts, len(data) + 1)[first] < hi
    lo, hi, first = lo[full], hi[full], first[full]
    line_row = np.searchsorted(offsets, lo, side="right") - 1
    n_lines = np.bincount(line_row, minlength=rows)
    keys = np.unique(np.stack([line_row, span_hashes(data, lo, hi).view(np.int64)], axis=1), axis=0)
    distinct = np.bincount(keys[:, 0], minlength=rows)
    bullets = np.bincount(line_row[_BULLET[data[starts[first]]]], minlength=rows)
    last = ends[np.searchsorted(starts, hi) - 1] if len(hi) else hi
    wide = np.r_[np.zeros(3, np.uint8), data]
    tail = np.stack([wide[last], wide[last + 1], wide[last + 2]], axis=1) if len(last) else np.zeros((0, 3), np.uint8)
    # Within the line: a line of fewer bytes can't end so.
    dots = ((tail == [46, 46, 46]).all(1) | (tail == [0xE2, 0x80, 0xA6]).all(1)) & (last - lo >= 3)
    ellipses = np.bincount(line_row[dots], minlength=rows)
    share = lambda count, of, prior: 1000 * count // (of + prior)
    out = {
        "symbols": share(per_row(_SYMBOL[data]), chars, PRIOR_CHARS),
        "capitals": share(per_row(_CAPITAL[data] | accented), chars, PRIOR_CHARS),
        "repeats": share(repeats, n_words, PRIOR_WORDS),
        "digits": share(per_row(_DIGIT[data]), chars, PRIOR_CHARS),
        "word_length": 10 * (letters + PRIOR_LENGTH * PRIOR_WORDS) // (n_words + PRIOR_WORDS),
        "line_repeats": share(n_lines - distinct, n_lines, PRIOR_LINES),
        "bullets": share(bullets, n_lines, PRIOR_LINES),
        "ellipses": share(ellipses, n_lines, PRIOR_LINES),
    }
    return {k: np.where(n_words > 0, v, -1) for k, v in out.items()}


def metrics(df: DataFrame, text: str, prefix: str, keep_text: bool = True) -> DataFrame:
    """``df`` (without the text, if not ``keep_text``) with a column ``prefix`` + rule for each rule; null where the text is null or blank."""
    at = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]
    # Names are places here: those of the table may clash.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = StructType([plain.schema[i] for i in kept] + [StructField(prefix + r, IntegerType()) for r in RULES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, part in text_slices(b.column(at)):
                values = measure(part)
                rows = b.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), *(pa.array(v.astype(np.int32), mask=v < 0) for v in values.values())], schema.names)

    return plain.mapInArrow(run, schema).toDF(*[df.columns[i] for i in kept], *[prefix + r for r in RULES])


def sketches(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, rule, bucket, n): the sketches of all documents with text. Null names count as ''."""
    p = "_q_"
    plain = df.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text"))
    measured = metrics(plain, "text", p, keep_text=False).where(F.col(p + "symbols").isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(f"{p}{r} div {WIDTH}").cast("int").alias("bucket")) for r in RULES]))
    return measured.select("lang", "source", pairs.alias("m")).groupBy("lang", "source", "m.rule", "m.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, rule, threshold) for every group of ``sketch``, a table as ``sketches`` gives it."""
    levels = {"g": ["lang", "source", "rule"], "l": ["lang", "rule"], "a": ["rule"]}
    out = sketch.select("lang", "source", "rule").distinct()
    spread = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
        up = Window.partitionBy(*keys).orderBy("bucket")
        ranked = merged.withColumn("_to", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
        low = [F.min(F.when(F.col("_to") * 100 >= F.col("_all") * q, F.col("bucket") * WIDTH)) for q in (50, 75)]
        fences = ranked.groupBy(*keys).agg(F.max("_all").alias(f"_n{level}"), low[0].alias("_mid"), low[1].alias("_high"))
        fence = F.col("_mid") + FENCE * F.greatest(F.col("_high") - F.col("_mid"), spread[F.col("rule")])
        out = out.join(fences.select(*keys, f"_n{level}", fence.alias(f"_f{level}")), keys)
    out = out.withColumn("_fl", F.expr(f"(_nl * _fl + {PRIOR} * _fa) div (_nl + {PRIOR})"))
    return out.select("lang", "source", "rule", F.expr(f"(_ng * _fg + {PRIOR} * _fl) div (_ng + {PRIOR})").alias("threshold"))


def keep_quality(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df`` that break no rule, with the columns of ``df``.

    Null, empty and blank texts are dropped (they have no content) and count in no sketch. Null and '' as language or
    source are one group. Repeated rows count and pass each on its own. A value equal to its threshold passes. Very
    long texts are measured whole. An empty table gives an empty one. Other columns pass through, whatever their names.
    """
    need(df, lang, source, text)
    limits = thresholds(cut_lineage(sketches(df, lang, source, text))).groupBy("lang", "source").pivot("rule", list(RULES)).agg(F.max("threshold"))
    p = fresh(df, "_q_")
    while any(c.lower().startswith(p.lower()) for c in df.columns):
        p += "_"
    lk, sk = p + "lang", p + "source"
    limits = limits.select(F.col("lang").alias(lk), F.col("source").alias(sk), *[F.col(r).alias(f"{p}max_{r}") for r in RULES])
    measured = metrics(df, text, p).withColumn(lk, F.coalesce(lang, F.lit(""))).withColumn(sk, F.coalesce(source, F.lit("")))
    measured = measured.where(F.col(p + "symbols").isNotNull())
    kept = join_small(measured, limits, [lk, sk])
    for r in RULES:
        kept = kept.where(F.col(p + r) <= F.col(f"{p}max_{r}"))
    return kept.select(*[kept[c] for c in df.columns])


_COUNTS = {
    "symbols": (f"length(text) - length(translate(text, '{SYMBOLS}', ''))", f"(length(text) + {PRIOR_CHARS})"),
    "capitals": (f"length(regexp_replace(text, '{UPPER}', '', 'g'))", f"(length(text) + {PRIOR_CHARS})"),
    "repeats": ("len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2]))", f"(len(w) + {PRIOR_WORDS})"),
    "digits": ("length(regexp_replace(text, '[^0-9]+', '', 'g'))", f"(length(text) + {PRIOR_CHARS})"),
    "line_repeats": ("(len(ln) - len(list_distinct(ln)))", f"(len(ln) + {PRIOR_LINES})"),
    "bullets": (f"len(list_filter(ln, lambda x: regexp_matches(x, '^\\s*[{BULLETS}]')))", f"(len(ln) + {PRIOR_LINES})"),
    "ellipses": ("len(list_filter(ln, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$')))", f"(len(ln) + {PRIOR_LINES})"),
}
_VALUES = {r: f"(1000 * ({n})) // {of}" for r, (n, of) in _COUNTS.items()} | {"word_length": f"(10 * (length(regexp_replace(text, '\\s+', '', 'g')) + {PRIOR_LENGTH * PRIOR_WORDS})) // (len(w) + {PRIOR_WORDS})"}
_M = """m AS (
  SELECT *, """ + ", ".join(f"CASE WHEN has_text THEN {_VALUES[r]} END AS {r}" for r in RULES) + """
  FROM (SELECT *, regexp_matches(text, '\\S') AS has_text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS ln, coalesce(lang, '') AS kl, coalesce(source, '') AS ks FROM documents)
)"""
_H = "h AS (" + " UNION ALL ".join(f"SELECT kl, ks, '{r}' AS rule, {s} AS least, {r} // {WIDTH} AS bucket, count(*) AS n FROM m WHERE {r} IS NOT NULL GROUP BY ALL" for r, s in RULES.items()) + ")"


def _level(name: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT {keys}, max(al) AS n, min(bucket * {WIDTH}) FILTER (to_ * 100 >= al * 50) + {FENCE} * greatest(min(bucket * {WIDTH}) FILTER (to_ * 100 >= al * 75) - min(bucket * {WIDTH}) FILTER (to_ * 100 >= al * 50), max(least)) AS fence
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS to_, sum(n) OVER (PARTITION BY {keys}) AS al FROM (SELECT {keys}, least, bucket, sum(n) AS n FROM h GROUP BY ALL)) GROUP BY ALL
)"""


KEEP_SQL = f"""WITH {_M}, {_H}, {_level("g", "kl, ks, rule")}, {_level("l", "kl, rule")}, {_level("a", "rule")},
t AS (SELECT kl, ks, rule, (g.n * g.fence + {PRIOR} * lf) // (g.n + {PRIOR}) AS threshold FROM g JOIN (SELECT kl, rule, (l.n * l.fence + {PRIOR} * a.fence) // (l.n + {PRIOR}) AS lf FROM l JOIN a USING (rule)) USING (kl, rule)),
p AS (SELECT kl, ks, """ + ", ".join(f"max(threshold) FILTER (rule = '{r}') AS max_{r}" for r in RULES) + """ FROM t GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars FROM m JOIN p USING (kl, ks) WHERE """ + " AND ".join(f"{r} <= max_{r}" for r in RULES)
