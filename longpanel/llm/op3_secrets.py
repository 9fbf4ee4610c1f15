"""Secret scans with multipart credential linking.  DataFrame functions only.

Base spans are found by three patterns, leftmost and non-overlapping for each kind.  Three further
patterns find weak parts (account names, opaque strings, endpoints), which alone mean little.  An
interval join within a scope (parts whose starts are at most ``SCOPE`` code points apart) links
them: an account name is reported with a secret near it, an opaque string with an identifier or an
endpoint near it, an endpoint with both an identifier and a secret near it.  A weak part that
overlaps a base span is the base span's and is not reported again.

All of it happens inside the row: patterns give pieces and matches, whose running lengths are
positions.  Whether a base span reaches into a weak part is told by the running maximum of base ends
from the left and of base starts from the right.  Parts of one kind do not overlap and have a least
length, so no more than ``NEIGHBOURS`` parts can start within a scope on either side: the interval
join looks at that many, which loses none.  Running values are made chunk by chunk, so a text of very
many spans costs little more than its length.

Edge cases: null and empty texts have no spans.  Repeated rows give repeated results.  Positions
are code points, end exclusive.  Of the input only doc_id and text are read; redact() carries all other
columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

SCOPE = 256
NEIGHBOURS = 128
#: Array elements that a running value is carried over at once.
CHUNK = 256
_FAR = 2**31 - 1

# Fixed patterns of the three base kinds; runs too short to count are left out by the repeat counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts.
IDENT = r"""(?i:user(?:name|_id)?|login|account(?:_id)?|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

#: Kinds in their order, with pattern and part: an identifier, a secret or an endpoint.
KINDS = {"assign": (ASSIGN, "secret"), "access": (ACCESS, "id"), "hex": (HEX, "secret"), "ident": (IDENT, "id"), "opaque": (OPAQUE, "secret"), "endpoint": (ENDPOINT, "endpoint")}
BASE = 3
_SPANS = "array<struct<start:int,kind_no:int,end:int>>"


def _accepted(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "opaque":
        return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _chunks(xs: Column) -> Column:
    last = F.floor((F.size(xs) - 1) / CHUNK).cast("int")
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _running(xs: Column, combine) -> Column:
    """The sums or maxima of an array of non-negative integers up to and with each element."""

    def scan(part, first):
        def step(s, x):
            v = combine(s["last"], x)
            return F.struct(v.alias("last"), F.array_append(s["out"], v).alias("out"))

        return F.aggregate(part, F.struct(first.alias("last"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def chunked(xs):
        part = lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK))
        totals = F.transform(_chunks(xs), lambda c: F.aggregate(part(c), F.lit(0), combine))
        firsts = F.concat(F.array(F.lit(0)), scan(totals, F.lit(0)))
        return _let(firsts, lambda f: F.flatten(F.transform(_chunks(xs), lambda c: scan(part(c), F.get(f, c)))))

    return _let(xs, chunked)


def matches(text: Column, kind: str) -> Column:
    """Spans of one kind in order: array of start, kind_no, end."""
    pattern, number = KINDS[kind][0], list(KINDS).index(kind)

    def found(hits):
        lengths = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.length(gap) + F.coalesce(F.length(hit), F.lit(0)))
        spans = F.zip_with(hits, _running(lengths, lambda a, b: a + b), lambda hit, end: F.when(hit.isNotNull() & _accepted(kind, hit), F.struct((end - F.length(hit)).alias("start"), F.lit(number).alias("kind_no"), end.alias("end"))))
        return F.filter(spans, lambda s: s.isNotNull()).cast(_SPANS)  # the last piece has no match after it

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(F.array().cast(_SPANS))


def _part(span: Column) -> Column:
    return F.element_at(F.array(*[F.lit(part) for _, part in KINDS.values()]), span["kind_no"] + 1)


def linked(base: Column, weak: Column) -> Column:
    """The weak spans that have complementary parts in their scope and overlap no base span."""

    def join(parts, ends, starts):
        def keep(span, i):
            others = F.slice(parts, F.greatest(i + 1 - NEIGHBOURS, F.lit(1)), F.lit(2 * NEIGHBOURS + 1))

            def near(*wanted):
                return F.exists(others, lambda o: _part(o).isin(*wanted) & (F.abs(o["start"] - span["start"]) <= SCOPE) & (o != span))

            covered = (F.get(ends, i) > span["start"]) | (_FAR - F.get(starts, F.size(parts) - 1 - i) < span["end"])
            rule = F.when(_part(span) == "id", near("secret")).when(_part(span) == "secret", near("id", "endpoint")).otherwise(near("id") & near("secret"))
            return (span["kind_no"] >= BASE) & ~covered & rule

        return F.filter(parts, keep)

    def of_base(value):
        return lambda s: F.when(s["kind_no"] < BASE, value(s)).otherwise(0)

    def sides(parts):
        ends = _running(F.transform(parts, of_base(lambda s: s["end"])), _largest)
        starts = _running(F.transform(F.reverse(parts), of_base(lambda s: _FAR - s["start"])), _largest)
        return _let(ends, lambda e: _let(starts, lambda s: join(parts, e, s)))

    return F.when(F.size(weak) > 0, _let(F.array_sort(F.concat(base, weak)), sides)).otherwise(F.array().cast(_SPANS))


def _scanned(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a struct of base (base spans in order) and spans (with the linked weak ones, in order)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*[matches(t, k) for k in list(KINDS)[:BASE]]))
    weak = F.concat(*[matches(t, k) for k in list(KINDS)[BASE:]])
    found = docs.withColumn(name, F.struct(base.alias("base"), weak.alias("weak")))
    every = F.array_sort(F.concat(F.col(name)["base"], linked(F.col(name)["base"], F.col(name)["weak"])))
    return found.withColumn(name, F.struct(F.col(name)["base"].alias("base"), every.alias("spans")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base (base spans in order) and spans (with the linked weak ones, in order) of each row."""
    return _scanned(docs.select("doc_id", text), text, "_found").select("doc_id", "_found.base", "_found.spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by a mark; overlapping spans share one mark."""
    name = fresh(docs, "_found")
    found, whole = _scanned(docs, text, name), F.col(text)
    spans = F.col(name)["spans"]

    def joined(cuts):
        """The gaps before the marks, each cut out of the stretch of text that its chunk covers."""

        def chunk(c):
            own = F.slice(cuts, c * CHUNK + 1, F.lit(CHUNK))
            stretch = lambda xs: whole.substr(F.get(xs, F.lit(0))["at"] + 1, F.element_at(xs, -1)["start"] - F.get(xs, F.lit(0))["at"])
            gaps = lambda xs, t: F.transform(xs, lambda x: F.concat(t.substr(x["at"] - F.get(xs, F.lit(0))["at"] + 1, x["start"] - x["at"]), F.lit(mark)))
            return _let(own, lambda xs: _let(stretch(xs), lambda t: F.array_join(gaps(xs, t), "")))

        return F.array_join(F.transform(_chunks(cuts), chunk), "")

    def cut(ends):
        # a mark begins where no earlier span reaches
        before = F.concat(F.array(F.lit(0)), ends)
        cuts = F.filter(F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda x: x["start"] >= x["at"])
        return F.concat(_let(cuts, joined), whole.substr(F.element_at(ends, -1) + 1, F.length(whole)))

    ends = _running(F.transform(spans, lambda s: s["end"]), _largest)
    found = found.withColumn(text, F.when(F.size(spans) > 0, _let(ends, cut)).otherwise(whole))
    return found.select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda no: F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def _sql_kind(number: int, kind: str) -> str:
    pattern = KINDS[kind][0].replace("'", "''")
    accept = {"assign": f"length(regexp_extract(m, '{pattern}', 2)) >= 6", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}.get(kind, "true")
    return f"""SELECT r, {number} AS k, s, s + length(m) AS e FROM (
  SELECT r, ms[i] AS m, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s
  FROM (SELECT r, gs, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_split_to_array(t, '{pattern}') AS gs, regexp_extract_all(t, '{pattern}') AS ms FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {accept}"""


_NEAR = "EXISTS (SELECT 1 FROM p o WHERE o.r = p.r AND abs(o.s - p.s) <= {scope} AND (o.k, o.s) <> (p.k, p.s) AND o.k IN ({kinds}))"
_near = lambda kinds: _NEAR.format(scope=SCOPE, kinds=kinds)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(KINDS))}),
x AS (SELECT * FROM p WHERE k < {BASE} OR (NOT EXISTS (SELECT 1 FROM p o WHERE o.r = p.r AND o.k < {BASE} AND o.s < p.e AND p.s < o.e)
  AND CASE WHEN k = 3 THEN {_near("0, 2, 4")} WHEN k = 4 THEN {_near("1, 3, 5")} ELSE {_near("1, 3")} AND {_near("0, 2, 4")} END)),
g AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h,
  string_agg(n, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base, string_agg(n, ',' ORDER BY s, k) AS spans
  FROM (SELECT *, [{", ".join(f"'{k}'" for k in KINDS)}][k + 1] || ':' || s || ':' || e AS n FROM x) GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
