r"""Personal data by bootstrapped contextual extraction, as Spark expressions only.

Base spans come from regular expressions. Their contexts (the two words before) are seeds of a graph of patterns and
instances: a pattern is as good as the share of its distinct instances that are known, an instance as good as the
patterns that extract it together (noisy or). Good instances are added to the known ones and the graph is scored again;
in the end, confident patterns mark identifiers that the expressions don't know.

Offsets are in code points, end exclusive: sums of the lengths of matches and of what stands between them.
Expressions start only where a run starts and take runs possessively, so each is linear in the text.

Defined results: a null text counts as empty; empty texts have no spans; rows that repeat give the same result each;
doc_id may be null or repeat (rows are told apart by id and text hash); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.llm.common import staged

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Linear forms of the base expressions: possessive runs, tried at the start of a run or the end of the last match.
EXPRESSIONS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an at sign: what a pattern may extract.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Matches whose offsets are summed in one run, and characters before a match that are looked at for its context.
BLOCK, REACH = 128, 48

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, char_length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(d, -i, 1)), "
    "int(substr(d, -i, 1)) * 2 - if(int(substr(d, -i, 1)) > 4, 9, 0))) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": rf"x.v rlike r'^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$'",
    "card": f"element_at(transform(array({_DIGITS}), d -> char_length(d) between 16 and 19 and {_LUHN}), 1)",
    "phone": f"char_length({_DIGITS}) between 8 and 15",
}
_NEEDS = {"email": "t like '%@%'", "ip": "t rlike '[0-9]'", "card": "t rlike '[0-9]'", "phone": "t like '%+%'"}


def _bound(value: str, name: str, body: str) -> str:
    """`value` evaluated once and bound to `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _located(regex: str, needs: str) -> Column:
    """All matches in column t as structs (s, e, v, c), leftmost first; c: the lower-cased two words before.

    The text is split at the matches, so offsets are sums of lengths. Sums run within blocks of `BLOCK` matches and over
    blocks, and contexts are put together from the ends of the pieces before, so the work follows the length of the text.
    """
    none = "cast(array() as array<struct<s:int,e:int,v:string,c:string>>)"
    # n: length of the gap before a match and of the match; u: the last characters of both; g: those of the gap alone
    step = (
        f"transform(m, (x, i) -> named_struct('v', x, 'n', char_length(x), 'd', char_length(get(g, i)), "
        f"'g', right(get(g, i), {REACH}), 'u', right(concat(right(get(g, i), {REACH}), right(x, {REACH})), {REACH})))"
    )
    total = "aggregate({}, 0, (a, y) -> a + y.n + y.d)".format
    blocks = f"transform(sequence(0, (size(w) - 1) div {BLOCK}), b -> slice(w, b * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform(bs, b -> {total('b')})"
    before = "aggregate(slice(ss, 1, i), 0, (a, y) -> a + y)"
    left = f"concat(array_join(transform(slice(w, greatest(1, i * {BLOCK} + j + 1 - {REACH}), least({REACH}, i * {BLOCK} + j)), y -> y.u), ''), x.g)"
    context = f"regexp_replace(regexp_extract(lower(right({left}, {REACH})), r'(\\S+\\s+)?\\S+\\s*+$', 0), r'\\s+', ' ')"
    spans = _bound(
        before,
        "p",
        "transform(b, (x, j) -> " + _bound(f"p + {total('slice(b, 1, j)')} + x.d", "q", f"named_struct('s', q, 'e', q + x.n, 'v', lower(x.v), 'c', {context})") + ")",
    )
    placed = _bound(step, "w", _bound(blocks, "bs", _bound(sums, "ss", f"flatten(transform(bs, (b, i) -> {spans}))")))
    pieces = _bound(f"split(t, r'{regex}', -1)", "g", placed)
    return F.expr(f"if({needs}, " + _bound(f"regexp_extract_all(t, r'{regex}', 0)", "m", f"if(size(m) = 0, {none}, {pieces})") + f", {none})")


def find_base(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h (hash of the text), one array of spans with contexts for each kind, and the candidates."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    out = out.select("doc_id", F.xxhash64("t").alias("h"), *(_located(EXPRESSIONS[k], _NEEDS[k]).alias(k) for k in KINDS), _located(CANDIDATE, "t rlike '[0-9@]'").alias("cand"))
    return out.select("doc_id", "h", "cand", *(F.expr(f"filter({k}, x -> {CHECKS[k]})").alias(k) for k in KINDS))


def bootstrap(base: DataFrame, min_support: int = 5, min_pattern: float = 0.8, min_instance: float = 0.9) -> DataFrame:
    """Spans that confident contexts add: doc_id, h, k (index of the kind), s, e.

    `min_support` distinct known instances and a share of `min_pattern` known ones make a pattern confident. Both are asked
    of what is known in each round, and rounds go on until nothing is added and no score grows.
    """
    spots = F.concat(*(F.expr(f"transform({k}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e, 'v', x.v, 'c', x.c))") for i, k in enumerate((*KINDS, "cand"))))
    # rows that repeat have the same spans
    seen = base.select("doc_id", "h", F.explode(spots).alias("x")).select("doc_id", "h", "x.*").distinct()
    cand = F.col("k") == len(KINDS)
    # candidates that overlap a base span go: the furthest end before one, and the next start after it
    order = Window.partitionBy("doc_id", "h").orderBy("s", "k", "e").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("doc_id", "h").orderBy(F.desc("s"), F.desc("k"), F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("until", F.max(F.when(~cand, F.col("e"))).over(order)).withColumn("next", F.min(F.when(~cand, F.col("s"))).over(back))
    clear = (F.coalesce("until", F.lit(0)) <= F.col("s")) & (F.coalesce("next", F.col("e")) >= F.col("e"))
    seen = seen.where((~cand | clear) & (F.length(F.trim("c")) > 0)).select("doc_id", "h", "k", "s", "e", "v", "c", F.when(cand & F.col("v").contains("@"), 1).otherwise(0).alias("at"))
    seen = staged(seen, "pii-contexts")
    # the graph: distinct pattern-instance links; seeds are known with their kind
    links = seen.groupBy("c", "v").agg(F.min(F.when(F.col("k") < len(KINDS), F.col("k"))).alias("seed"))
    known = links.where("seed is not null").groupBy("v").agg(F.min("seed").alias("kind")).withColumn("score", F.lit(1.0))
    # a context of fewer instances than `min_support` can't become a pattern in any round
    sizes = links.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)
    graph = staged(links.join(sizes, "c").select("c", "v", "n"), "pii-graph")
    known = staged(known, "pii-known")

    def reached() -> tuple:
        """How many are known, and the sum of their scores: none leaves and no score falls, so rounds come to an end."""
        n, total = known.agg(F.count("*"), F.sum("score")).first()
        return n, round(total or 0.0, 6)

    before, now = None, reached()
    while now != before:
        scored = graph.join(known, "v")
        patterns = (
            scored.groupBy("c", "kind", "n")
            .agg(F.sum("score").alias("good"), F.count("*").alias("support"))
            .withColumn("conf", F.col("good") / F.col("n"))
            .where((F.col("support") >= min_support) & (F.col("conf") >= min_pattern))
            .select("c", "kind", "conf")
        )
        patterns = staged(patterns, "pii-patterns")
        found = graph.join(patterns, "c").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
        known = (
            known.unionByName(found.where(F.col("score") >= min_instance).select("v", "kind", "score"))
            .groupBy("v")
            .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        )
        known = staged(known, "pii-known")
        before, now = now, reached()
    fits = F.when(F.col("kind") == 0, F.col("at") == 1).otherwise((F.col("at") == 0) & (F.regexp_count("v", F.lit("[0-9]")) >= 6))
    return (
        seen.where(F.col("k") == len(KINDS))
        .join(patterns, "c")
        .where(fits)
        .groupBy("doc_id", "h", "s", "e")
        .agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("k"))
        .select("doc_id", "h", "k", "s", "e")
    )


def scan(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, base spans by kind, and `extra`, the spans that the bootstrapped patterns add."""
    base = staged(find_base(docs), "pii-base")
    more = bootstrap(base, **settings).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("k", "s", "e"))).alias("extra"))
    a, b = base.alias("a"), more.alias("b")
    joined = a.join(b, F.expr("a.doc_id <=> b.doc_id and a.h = b.h"), "left")
    plain = [F.expr(f"transform(a.{k}, x -> named_struct('k', {i}, 's', x.s, 'e', x.e))").alias(k) for i, k in enumerate(KINDS)]
    return joined.select("a.doc_id", *plain, F.expr("coalesce(b.extra, cast(array() as array<struct<k:int,s:int,e:int>>))").alias("extra"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, by kind, then start."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and the list of all spans, per document."""
    base = F.concat(*KINDS)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, "extra")).alias("spans"),
    )
