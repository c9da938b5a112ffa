"""Secrets in texts: three fixed patterns, and strings that a character Markov model takes for random.

Two first-order Markov models over the characters of base64 and identifiers give the probability of each
character after the one before it, smoothed by ``SMOOTH``.  One is trained on strings labelled random, the
other on strings labelled ordinary.  A candidate is a run of ``LEAST_CHARS`` or more such characters that
no pattern touches and that has a letter, since numbers alone are no secret; it is one where its
log-likelihood ratio, in thousandths, is above ``MARGIN``.

``samples`` labels the strings of a corpus: the values that the patterns find, and strings made from
digests, are random; the other runs of a text that are too short for a candidate are ordinary, so secrets
without a label do not count as ordinary.  Every different string counts once, and no frequent word
outweighs the rest.  The trained table has one entry for each pair of characters.

Everything is DataFrame functions.  Pattern matches give the pieces between them and their lengths; the
pieces become rows, and running sums of the lengths inside a document are the offsets, in code points.
Only lengths and matches leave the scan, texts do not.  A document's spans stand in one task, which its
own length bounds.

A null text is empty and has no spans; null ids and repeated rows are rows of their own; spans of one kind
do not overlap, of several kinds they may.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gameline.llm.common import table, texts

MARKED = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# kind: pattern, the group that holds the secret, the least length of that group
PATTERNS = {
    "assign": (f"({'|'.join(map(_either_case, MARKED))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is too short has no match inside it either, so the length stands in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*PATTERNS, "random")
RUN = r"[A-Za-z0-9+/_=-]{2,}"
LEAST_CHARS = 16
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_CHARS
MARGIN = 20_000
SCALE = 1000
SMOOTH = 0.5
MADE = 1000

_FIRST, _WIDTH = ord("+"), ord("z") - ord("+") + 1  # characters as numbers from 0; _WIDTH stands before the first
_CHARACTERS = 67


def _codes(value: Column) -> Column:
    """The characters of a string as numbers, after the number for the beginning."""
    return F.concat(F.array(F.lit(_WIDTH)), F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST))


def _pairs(codes: Column) -> Column:
    """Each character with the one before it as one number; the last has none and is null."""
    return F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: a * _WIDTH + b)


def _inner(match: Column, kind: str) -> Column:
    pattern, group, _ = PATTERNS[kind]
    return match if group == 0 else F.regexp_extract(match, pattern, group)


def _inners(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: _inner(m, kind))


def _long_enough(strings: Column, least: int) -> Column:
    return F.filter(strings, lambda v: F.length(v) >= least)


def _at_least(strings: Column, least: int) -> Column:
    return F.transform(strings, lambda v: F.length(v) >= least)


def made_strings(spark: SparkSession, n: int = MADE) -> DataFrame:
    """text: random strings of digests, in hex, base64, and capitals with digits."""
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")).cast("binary"), 256)
    based = F.base64(F.unhex(digest))
    return spark.range(n).select(F.explode(F.array(digest, based, F.upper(F.regexp_replace(based, "[+/=]", "")))).alias("text"))


def samples(docs: DataFrame, made: int = MADE) -> DataFrame:
    """text, label: the different strings of a corpus that count as random (1) and as ordinary (0)."""
    text = texts(docs).select("text")
    labelled, rest = [], F.col("text")
    for kind, (pattern, _, least) in PATTERNS.items():
        labelled.append(_long_enough(_inners(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), kind), least))
        rest = F.regexp_replace(rest, pattern, " ")
    values = _long_enough(F.concat(*labelled), LEAST_CHARS)
    short = F.filter(F.regexp_extract_all(rest, F.lit(RUN), F.lit(0)), lambda v: F.length(v) < LEAST_CHARS)
    runs = text.select(values.alias("_1"), short.alias("_0"))
    runs = runs.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("_1").alias("of")),
                                         F.struct(F.lit(0).alias("label"), F.col("_0").alias("of")))).alias("s"))
    runs = runs.select(F.col("s.label").alias("label"), F.explode("s.of").alias("text"))
    ours = made_strings(docs.sparkSession, made).select(F.lit(1).alias("label"), "text")
    return runs.unionByName(ours).distinct().select("text", "label")


def train(labelled: DataFrame) -> list[int]:
    """The log of the ratio of both models' chances, random over ordinary, for each pair of characters."""
    counted = (labelled.where(F.col("text").rlike("^[A-Za-z0-9+/_=-]+$") & F.col("label").isin(0, 1))
               .select("label", F.explode(_pairs(_codes(F.col("text")))).alias("pair"))
               .where(F.col("pair").isNotNull()).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")))
    n = {(r.label, r.pair): r.n for r in counted.collect()}  # at most one row for each label and pair of characters
    before: dict[tuple[int, int], int] = {}
    for (label, pair), k in n.items():
        before[label, pair // _WIDTH] = before.get((label, pair // _WIDTH), 0) + k

    def chance(label: int, pair: int) -> float:
        return (n.get((label, pair), 0) + SMOOTH) / (before.get((label, pair // _WIDTH), 0) + SMOOTH * _CHARACTERS)

    return [math.floor(SCALE * (math.log(chance(1, p)) - math.log(chance(0, p)))) for p in range((_WIDTH + 1) * _WIDTH)]


def ratios(strings: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of each string of an array."""
    cells = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded into one constant
    return F.transform(strings, lambda s: F.aggregate(
        _pairs(_codes(s)), F.lit(0).cast("long"), lambda total, p: total + F.coalesce(F.get(cells, p), F.lit(0))))


def _pieces(kind: int, pattern: str, good) -> Column:
    """One struct for each match in the text: what stands before it as a length, the match, and whether it counts."""
    matches = F.col(f"m{kind}")
    gaps = F.when(F.size(matches) > 0, F.transform(F.split("text", pattern, -1), F.length))
    zipped = F.arrays_zip(F.coalesce(gaps, F.array().cast("array<int>")).alias("gap"), matches.alias("found"), good.alias("good"))
    numbered = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["found"].alias("found"), z["good"].alias("good")))
    return F.filter(numbered, lambda z: z["found"].isNotNull())


def scan(docs: DataFrame, model: list[int], margin: int = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans of every document: an array of (start, kind_no, end, kind, found), in that order.

    ``kind_no`` is the place of the kind in ``KINDS``.
    """
    patterns = [*(p for p, _, _ in PATTERNS.values()), CANDIDATE]
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    found = rows.withColumns({f"m{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)})
    good = [_at_least(_inners(F.col(f"m{k}"), kind), least) for k, (kind, (_, _, least)) in enumerate(PATTERNS.items())]
    strings = F.col(f"m{len(patterns) - 1}")
    good.append(F.zip_with(strings, ratios(strings, model), lambda s, r: (r > margin) & s.rlike("[A-Za-z]")))
    pieces = found.select("row", "doc_id", F.concat(*[_pieces(k, p, g) for k, (p, g) in enumerate(zip(patterns, good))]).alias("pieces"))
    at = pieces.select("row", "doc_id", F.explode_outer("pieces").alias("p")).select("row", "doc_id", "p.*").repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (at.withColumn("end", F.sum(F.col("gap") + F.length("found")).over(so_far).cast("long"))
             .withColumn("start", F.col("end") - F.length("found")))
    # a candidate goes where a span of a pattern begins inside it or reaches into it
    fixed = F.col("good") & (F.col("kind") < len(PATTERNS))
    in_row = Window.partitionBy("row")  # both frames only grow, one from each end of the document
    reach = F.max(F.when(fixed, F.col("end"))).over(in_row.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(fixed, F.col("start"))).over(in_row.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(follows, F.col("end")) >= F.col("end"))
    counts = F.col("good") & (fixed | F.col("free"))
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", F.col("kind").alias("kind_no"), "end", F.get(names, "kind").alias("kind"), "found")
    return (spans.withColumn("free", free).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(counts, span))).alias("spans")).drop("row"))


def secrets(docs: DataFrame, model: list[int], **settings) -> DataFrame:
    """doc_id, kind, start, end, found: one row for each span."""
    return (scan(docs, model, **settings).select("doc_id", F.explode("spans").alias("s"))
            .select("doc_id", "s.kind", "s.start", "s.end", "s.found"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number_of(spans: Column, kind_no: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == kind_no)).cast("long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(samples(docs)))
    of = {k: _number_of(F.col("spans"), n) for n, k in enumerate(PATTERNS)}
    base = _listed(F.filter("spans", lambda s: s["kind_no"] < len(PATTERNS)))
    return found.select("doc_id", *[c.alias(f"n_{k}") for k, c in of.items()],
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SQL_KINDS = " UNION ALL ".join(
    f"SELECT row, {k} AS kind, {least} AS least, {group} AS grp, regexp_extract_all(text, {_quoted(p)}) AS ms, "
    f"string_split_regex(text, {_quoted(p)}) AS gs FROM d"
    for k, (p, group, least) in enumerate([*PATTERNS.values(), (CANDIDATE, 0, LEAST_CHARS)]))
_SQL_INNER = f"CASE grp WHEN 2 THEN regexp_extract(found, {_quoted(PATTERNS['assign'][0])}, 2) ELSE found END"
_SQL_REST = "text"
for _p, _, _ in PATTERNS.values():
    _SQL_REST = f"regexp_replace({_SQL_REST}, {_quoted(_p)}, ' ', 'g')"

OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({_SQL_KINDS}),
each AS (SELECT row, kind, least, grp, i, ms[i] AS found, length(gs[i]) AS gap
         FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut WHERE len(ms) > 0)),
placed AS (SELECT row, kind, least, {_SQL_INNER} AS inside, found,
                  sum(gap + length(found)) OVER (PARTITION BY row, kind ORDER BY i) - length(found) AS s FROM each),
spans AS (SELECT row, kind, inside, found, CAST(s AS BIGINT) AS s, CAST(s + length(found) AS BIGINT) AS e
          FROM placed WHERE length(inside) >= least),
random AS (
  SELECT inside AS t FROM spans WHERE kind < 3 AND length(inside) >= {LEAST_CHARS}
  UNION ALL
  SELECT unnest([h, b, upper(regexp_replace(b, '[+/=]', '', 'g'))])
  FROM (SELECT h, to_base64(from_hex(h)) AS b FROM (SELECT sha256('random:' || range) AS h FROM range({MADE})))),
labelled AS (
  SELECT DISTINCT 1 AS label, t FROM random WHERE regexp_full_match(t, '[A-Za-z0-9+/_=-]+')
  UNION ALL
  SELECT DISTINCT 0, t FROM (SELECT unnest(regexp_extract_all({_SQL_REST}, {_quoted(RUN)})) AS t FROM d) WHERE length(t) < {LEAST_CHARS}),
pairs AS (
  SELECT label, CASE WHEN i = 1 THEN '' ELSE substr(t, i - 1, 1) END AS a, substr(t, i, 1) AS b, count(*) AS n
  FROM (SELECT label, t, unnest(range(1, length(t) + 1)) AS i FROM labelled) GROUP BY ALL),
letters AS (SELECT unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-', '')) AS c),
grid AS (SELECT a, c AS b FROM (SELECT c AS a FROM letters UNION ALL SELECT '') CROSS JOIN letters),
models AS (
  SELECT a, b, label, (coalesce(n, 0) + {SMOOTH}) / (sum(coalesce(n, 0)) OVER (PARTITION BY a, label) + {SMOOTH * _CHARACTERS}) AS p
  FROM grid CROSS JOIN (SELECT unnest([0, 1]) AS label) LEFT JOIN pairs USING (a, b, label)),
ratio AS (SELECT a, b, CAST(floor({SCALE} * (ln(max(p) FILTER (label = 1)) - ln(max(p) FILTER (label = 0)))) AS BIGINT) AS r
          FROM models GROUP BY a, b),
judged AS (
  SELECT row, s, e FROM (SELECT row, s, e, found, unnest(range(1, length(found) + 1)) AS i FROM spans
        WHERE kind = 3 AND regexp_matches(found, '[A-Za-z]')) c
  JOIN ratio ON ratio.a = CASE WHEN i = 1 THEN '' ELSE substr(found, i - 1, 1) END AND ratio.b = substr(found, i, 1)
  GROUP BY row, s, e HAVING sum(r) > {MARGIN}),
kept AS (
  SELECT row, kind, s, e FROM spans WHERE kind < 3
  UNION ALL
  SELECT row, 3, s, e FROM judged j
  WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind < 3 AND b.row = j.row AND b.s < j.e AND b.e > j.s)),
told AS (SELECT row, kind, s, e, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || s || ':' || e AS says FROM kept)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(says, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(says, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN told USING (row) GROUP BY row, doc_id"""

QUERIES = {"op12_secret_scan": (op12, OP12_SQL)}
