"""Personal data: exact base formats, then bootstrapped contextual extraction.

DataFrame functions only. Base spans are found by one regex a kind; Spark has
no find-all with positions, so places come from the gaps between matches
(``split``) and the matches (``regexp_extract_all``). The regexes are written
with possessive quantifiers, which match the same strings as the contract's
greedy ones (no class contains what follows it) but neither backtrack nor
recurse on very long runs.

Bootstrapping: base spans are the seeds. The word before a mention and the word
after it are lexical patterns. Patterns and instances (identifier-like strings)
form a bipartite graph that is scored for ``rounds`` rounds. Each round the
patterns are induced anew from the seeds and from all instances accepted so far:
a pattern needs ``support`` distinct ones of a kind, and its confidence is the
share of all its occurrences in the corpus that stand by an instance of that
kind, weighted by the instances' confidence; an instance's is the noisy or of its
patterns. Instances at ``accept`` or more that are formatted like the kind, but
unlike the base format, become spans at each of their places: so an instance that
one pattern finds makes new patterns of the words that stand by it elsewhere.

A candidate is a word with a digit or an @, or a run of number groups from such a
word on: the word alone and the longest run that may be an instance both count,
and the more trusted one, of equal ones the longer, becomes the span.

Null and empty texts have no spans. Rows are kept as they repeat in the input.
Offsets are code points, ends exclusive. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordat.session import materialize

KINDS = ("email", "ip", "card", "phone")

#: What a text must hold to be searched for a kind, and the kind's format.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Runs that candidates are cut from: a word with a digit or @, and the number groups after it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(]?[0-9]\S*+)*+"
#: What an unseen instance of a kind may look like.
LIKE = {"email": r"^[^@]+@[^@]+$", "ip": r"^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]+){3,7}$", "card": r"^(?:[^0-9]*+[0-9]){13,19}[^0-9]*$", "phone": r"^[^A-Za-z@]*$"}
PHONE_DIGITS = r"^(?:[^0-9]*+[0-9]){7,15}[^0-9]*$"
#: Number groups of a run that can be one instance: each has a digit, and no kind but email has more digits.
#: An instance of the kind email is an address with up to so many groups in all.
GROUPS = 19
#: Matches whose lengths are added up in one go when places are computed.
BLOCK = 64
#: White space other than the space itself.
SPACES = "\t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Params:
    rounds: int = 3
    support: int = 3  # distinct accepted instances that a pattern needs
    pattern: float = 0.5  # confidence that a pattern needs
    accept: float = 0.5  # confidence that an instance needs
    #: Patterns of up to so many rows (of under 100 bytes) are broadcast to count their occurrences.
    broadcast_patterns: int = 100_000


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn check of a string of 13 to 19 digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, x * 2).otherwise(x)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        d = _digits(s)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables are, columns inside lambdas are not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, s, before, after>> of the matches of a pattern, with the words beside them.

    Starts are sums of the lengths of all gaps and matches before, by blocks of ``BLOCK``.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.lit(BLOCK)

    def measured(v: Column) -> Column:
        lens = F.zip_with(F.slice(v["gaps"], F.lit(1), F.size(v["hits"])), v["hits"], lambda g, h: F.length(g) + F.length(h))
        return _let(F.struct(v["gaps"].alias("gaps"), v["hits"].alias("hits"), lens.alias("lens")), blocks)

    def blocks(v: Column) -> Column:
        n = F.size(v["hits"])
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda j: _sum(F.slice(v["lens"], j * step + 1, step)))
        with_sums = F.struct(v["gaps"].alias("gaps"), v["hits"].alias("hits"), v["lens"].alias("lens"), sums.alias("sums"))
        return _let(with_sums, lambda x: _let(F.struct(*[x[c].alias(c) for c in ("gaps", "hits", "lens")], F.transform(x["sums"], lambda _, j: _sum(F.slice(x["sums"], F.lit(1), j))).alias("ahead")), rows))

    def rows(v: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            gap = F.get(v["gaps"], i)
            start = F.get(v["ahead"], block) + _sum(F.slice(v["lens"], block * step + 1, i % step)) + F.length(gap)
            return F.struct(
                start.cast("int").alias("start"), (start + F.length(h)).cast("int").alias("stop"), h.alias("s"), _last_word(gap).alias("before"), _first_word(F.get(v["gaps"], i + 1)).alias("after"),
            )

        return F.transform(v["hits"], one)

    kind = "array<struct<start:int,stop:int,s:string,before:string,after:string>>"
    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), lambda v: F.when(F.size(v["hits"]) > 0, measured(v)))
    return F.coalesce(found.cast(kind), F.array().cast(kind))


def _last_word(gap: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(F.translate(gap, SPACES, " " * len(SPACES))), " ", -1))


def _first_word(gap: Column) -> Column:
    return F.lower(F.substring_index(F.ltrim(F.translate(gap, SPACES, " " * len(SPACES))), " ", 1))


SPANS = "array<struct<kind:int,start:int,stop:int,s:string,before:string,after:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """Valid base spans of a kind, leftmost first."""
    found = F.filter(_places(text, FORMATS[kind]), lambda x: _valid(kind, x["s"]))
    named = F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), *[x[c].alias(c) for c in ("start", "stop", "s", "before", "after")])).cast(SPANS)
    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
    return F.when(needed, named).otherwise(F.array().cast(SPANS))


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and then start."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _like(kind: Column, s: Column) -> Column:
    """Could this string be an instance of the kind?"""
    checks = [(kind == i) & s.rlike(LIKE[k]) & (s.rlike(PHONE_DIGITS) if k == "phone" else F.lit(True)) for i, k in enumerate(KINDS)]
    return checks[0] | checks[1] | checks[2] | checks[3]


def _of_any_kind(s: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [_like(F.lit(i), s) for i in range(len(KINDS))]), F.lit(False))


def _bare(s: Column) -> Column:
    """A candidate without the punctuation around it."""
    return F.regexp_replace(s, r"^[^0-9A-Za-z@+(]++|[^0-9A-Za-z]++$", "")


def _before(numbers: Column) -> Column:
    """Sums of the numbers before each place, the whole sum last, in two levels of blocks."""
    step = F.lit(BLOCK)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / step).cast("int")), lambda j: _sum(F.slice(x, j * step + 1, step)))
    ahead = lambda x: F.transform(x, lambda _, j: _sum(F.slice(x, F.lit(1), j)))

    def each(v: Column) -> Column:
        def one(i: Column) -> Column:
            block = F.floor(i / step).cast("int")
            return F.get(v["ahead"], block) + _sum(F.slice(v["x"], block * step + 1, i % step))

        return F.transform(F.sequence(F.lit(0), F.size(v["x"])), one)

    return _let(numbers, lambda x: _let(blocks(x), lambda y: _let(F.struct(x.alias("x"), ahead(y).alias("ahead")), each)))


#: Digits that a candidate of several groups must have: those of a phone number at least, of a card number at most.
FEW, MANY = 7, 19


def _cut(run: Column) -> Column:
    """array<struct<start, stop, s, before, after>> of the candidates in a run (start, s, before, after).

    From each group on: the shortest and the longest run of groups that may be an
    instance. Inside a run the words beside a candidate are the groups beside it;
    at its ends those beside the run.
    """

    def cut(v: Column) -> Column:
        groups, n = v["groups"], F.size(v["groups"])

        def from_group(i: Column) -> Column:
            made = lambda k: _bare(F.array_join(F.slice(groups, i + 1, k), " "))
            digits = lambda k: F.get(v["digits"], i + k) - F.get(v["digits"], i)
            # Several groups make no address of dots or colons: what they may be shows in their digits or an @.
            could = lambda k: (k == 1) | digits(k).between(FEW, MANY) | (F.get(v["ats"], i + k) > F.get(v["ats"], i))
            pick = lambda sizes: F.aggregate(sizes, F.lit(None).cast("int"), lambda got, k: F.when(got.isNotNull(), got).when(could(k), F.when(_of_any_kind(made(k)), k)))
            most = F.least(F.lit(GROUPS), n - i)
            sizes = F.array_compact(F.array_distinct(F.array(pick(F.sequence(most, F.lit(1), F.lit(-1))), pick(F.sequence(F.lit(1), most)))))
            lead = F.length(F.regexp_extract(F.get(groups, i), r"^[^0-9A-Za-z@+(]*+", 0))
            start = v["run"]["start"] + F.get(v["starts"], i) + lead

            def one(k: Column) -> Column:
                before = F.when(i == 0, v["run"]["before"]).otherwise(F.lower(F.get(groups, i - 1)))
                after = F.when(i + k == n, v["run"]["after"]).otherwise(F.lower(F.get(groups, i + k)))
                return F.struct(start.cast("int").alias("start"), (start + F.length(made(k))).cast("int").alias("stop"), made(k).alias("s"), before.alias("before"), after.alias("after"))

            return F.transform(sizes, one)

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_group))

    def counted(v: Column) -> Column:
        sums = {"starts": lambda g: F.length(g) + 1, "digits": lambda g: F.length(_digits(g)), "ats": lambda g: F.length(g) - F.length(F.translate(g, "@", ""))}
        return _let(F.struct(v["run"].alias("run"), v["groups"].alias("groups"), *[_before(F.transform(v["groups"], f)).alias(k) for k, f in sums.items()]), cut)

    return _let(F.struct(run.alias("run"), F.split(run["s"], " ", -1).alias("groups")), counted)


def _mentions(rows: DataFrame) -> DataFrame:
    """Seeds and candidates: rid, kind (null: candidate), start, stop, s, before, after (the words beside it).

    Candidates that overlap a base span are none: one pass over the ends of the
    former and the starts of the latter, in order, knows how far spans reach.
    """
    cols = ["rid", "kind", "start", "stop", "s", "before", "after"]
    seeds = rows.where("size(base) > 0").select("rid", F.explode("base").alias("b")).select("rid", "b.*").select(*cols)

    def candidates(some: DataFrame) -> DataFrame:
        runs = some.where(F.col("text").rlike("[0-9@]")).select("rid", F.explode(_places(F.col("text"), CANDIDATE)).alias("c"))
        return runs.select("rid", F.explode(_cut(F.col("c"))).alias("x")).where("x.s <> ''").select("rid", F.lit(None).cast("int").alias("kind"), "x.*").select(*cols)

    base = seeds.select("rid", F.col("start").alias("pos"), F.lit(1).alias("is_base"), F.col("stop").alias("reach"), *[F.lit(None).cast(t).alias(c) for c, t in zip(cols[1:], ("int", "int", "int", "string", "string", "string"))])
    mixed = candidates(rows.where("size(base) > 0")).select("rid", F.col("stop").alias("pos"), F.lit(0).alias("is_base"), F.lit(None).cast("int").alias("reach"), *cols[1:])
    w = Window.partitionBy("rid").orderBy("pos", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = mixed.unionByName(base).withColumn("reach", F.max("reach").over(w)).where("is_base = 0 and (reach is null or reach <= start)")
    return seeds.unionByName(candidates(rows.where("size(base) = 0"))).unionByName(swept.select(*cols))


def bootstrap(rows: DataFrame, corpus: DataFrame, params: Params = Params()) -> DataFrame:
    """Discovered spans (rid, kind, start, stop) of ``rows`` (rid, text, base); words are counted over the texts of ``corpus``."""
    mentions = materialize(_mentions(rows), "mentions")
    none = mentions.limit(0).select("rid", "kind", "start", "stop")
    if mentions.where("kind is null").isEmpty():
        return none
    beside = F.explode(F.array(F.struct(F.lit("<").alias("side"), F.col("before").alias("word")), F.struct(F.lit(">").alias("side"), F.col("after").alias("word"))))
    edges = mentions.select("s", "kind", beside.alias("p")).where("p.word <> ''").groupBy("p.side", "p.word", "s").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    edges = materialize(edges, "edges")
    # Patterns beside fewer strings than the support asks for never count.
    some = edges.groupBy("side", "word").agg(F.count(F.lit(1)).alias("strings"), F.sum("n").alias("most")).where(F.col("strings") >= params.support)
    some = materialize(some, "patterns")
    words = materialize(some.select("word").distinct(), "words")
    n = words.count()
    if not n:
        return none
    # How often each pattern's word stands in the corpus, beside whatever.
    everywhere = corpus.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    if n <= params.broadcast_patterns:
        seen = everywhere.join(F.broadcast(words), "word").groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    else:
        seen = everywhere.groupBy("word").agg(F.count(F.lit(1)).alias("total")).join(words, "word")
    # A word glued to a mention is no word of its own in the corpus: then what is known is all there is.
    # A pattern that cannot reach the confidence even if all it stands by are instances is out at once.
    room = some.join(seen, "word", "left").withColumn("total", F.greatest("most", F.coalesce("total", F.lit(0)))).where(F.col("most") >= F.col("total") * params.pattern)
    graph = materialize(edges.join(room.select("side", "word", "total"), ["side", "word"]), "graph")
    seeds = mentions.where("kind is not null").select("s", "kind").distinct().withColumn("conf", F.lit(1.0))
    known = materialize(seeds.join(graph.select("s").distinct(), "s", "left_semi"), "instances")
    instances = known
    for _ in range(params.rounds):
        trusted = (
            graph.select("side", "word", "s", "n", "total").join(instances, "s").groupBy("side", "word", "kind", "total")
            .agg((F.sum(F.col("n") * F.col("conf")) / F.col("total")).alias("trust"), F.count_if(F.col("conf") >= params.accept).alias("support"))
            .where((F.col("trust") >= params.pattern) & (F.col("support") >= params.support)).select("side", "word", "kind", F.least("trust", F.lit(0.999)).alias("trust"))
        )
        found = (
            graph.where("kind is null").select("side", "word", "s").join(trusted, ["side", "word"]).where(_like(F.col("kind"), F.col("s")))
            .groupBy("s", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("conf"))
        )
        instances = materialize(known.unionByName(found.join(known.select("s").distinct(), "s", "left_anti")), "instances")
    best = instances.where(F.col("conf") >= params.accept).groupBy("s").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b"))
    spans = mentions.where("kind is null").join(best, "s").select("rid", (-F.col("b.k")).alias("kind"), "start", "stop", F.col("b.conf").alias("conf")).distinct()
    spans = materialize(spans, "found")
    # Of candidates that overlap, the more trusted one stays, of equal ones the longer, then the first.
    # Those that overlap share a stretch of the text; a stretch has no more spans than characters, about.
    stretch = lambda c: F.floor(c / F.lit(BLOCK))
    cells = spans.withColumn("cell", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("stop") - 1))))
    a, b = cells.alias("a"), cells.alias("b")
    rank = lambda t: F.struct(F.col(f"{t}.conf"), F.col(f"{t}.stop") - F.col(f"{t}.start"), -F.col(f"{t}.start"))
    over = (F.col("a.rid") == F.col("b.rid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop")) & (rank("a") < rank("b"))
    worse = a.join(b, over, "left_semi").select("rid", "kind", "start", "stop").distinct()
    return spans.select("rid", "kind", "start", "stop").join(worse, ["rid", "kind", "start", "stop"], "left_anti")


def _is(kind: int):
    return lambda x: x["kind"] == kind


def find(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (kind, start, stop of every span) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text", text)
    each = picked.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text", F.concat(*[base_spans(F.col("text"), k) for k in KINDS]).alias("base"))
    # Row ids are drawn once: rows with anything to find are written with their texts, of the others only the id.
    rows = materialize(each.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text"))), "rows")
    more = bootstrap(rows.where("text is not null"), picked, params)
    extra = more.groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))
    plain = "array<struct<kind:int,start:int,stop:int>>"
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    joined = rows.select("doc_id", "rid", base.cast(plain).alias("base")).join(extra, "rid", "left")
    every = F.concat("base", F.coalesce(F.col("more").cast(plain), F.array().cast(plain)))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(every).alias("spans"), F.array_sort(every).alias("found"))
