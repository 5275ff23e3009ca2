"""Personal data by information-theoretic sanitisation, with DataFrame functions only.

Patterns find the protected entities: e-mail addresses, network addresses, card and phone numbers. The whole corpus then
says how strongly a word beside an entity reveals it: with p the share of documents that hold something,

    information(entity) = -log2 p(entity)
    revealed(word, entity) = log2 (p(word beside entity) / (p(word) p(entity)))

and revealed / information is the word's disclosure: 1 if the word never occurs without the entity, 0 if the two are
independent. In documents where it stands beside the entity, a word above a threshold is generalised to its kind, and one
above a higher threshold is removed, at each of its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Characters of text beside an entity, on either side and up to the next entity of its kind, in which words count as beside it.
REACH = 64
#: A pair counts once it is seen in so many different surroundings: copies of one passage are no evidence.
CONTEXTS = 3
#: Entities with less information than this, in bits, are known to all: nothing reveals them.
LEAST_BITS = 3.0
#: Disclosure from which a word is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.75, 0.9

#: Each possessive and begun only where a run begins or the last match ended, so that a long run is read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word of the method: three letters or digits, or more.
TERM = r"[\p{L}\p{M}\p{N}]{3,}"
_EDGE = r"[\p{L}\p{M}\p{N}]"
_BLOCK = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / _BLOCK)), lambda b: F.slice(items, (b * _BLOCK + 1).cast("int"), _BLOCK))


def matches(text: Column, pattern: Column | str) -> Column:
    """Array of (start, end, value, left, right), one for each match, leftmost first: code points, end exclusive. left and right
    are the text between this match and its neighbours as far as REACH, without words that are cut off there.

    Starts are sums of the lengths before, block by block, so that texts with very many matches stay cheap.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    size = lambda x: (x["gap"] + x["size"]).cast("long")
    total = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + of(x))
    long = lambda part: F.length(part) > REACH

    def around(parts: Column) -> Column:
        def item(m: Column, i: Column) -> Column:
            left, right = F.right(parts[i], F.lit(REACH)), F.left(parts[i + 1], F.lit(REACH))
            return F.struct(
                F.length(parts[i]).alias("gap"), F.length(m).alias("size"), m.alias("value"),
                F.when(long(parts[i]), F.regexp_replace(left, f"^{_EDGE}+", "")).otherwise(left).alias("left"),
                F.when(long(parts[i + 1]), F.regexp_replace(right, f"{_EDGE}++$", "")).otherwise(right).alias("right"),
            )

        return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), item)

    def placed(block: Column, base: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            return _let(base + total(F.slice(block, 1, i), size) + x["gap"], lambda start: F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))

        return F.transform(block, at)

    def in_blocks(items: Column) -> Column:
        return _let(_blocks(items), lambda blocks: _let(
            F.transform(blocks, lambda b: total(b, size)),
            lambda sums: F.flatten(F.zip_with(blocks, F.transform(sums, lambda s, k: total(F.slice(sums, 1, k), lambda x: x)), placed)),
        ))

    return _let(F.split(text, pattern, -1), lambda parts: _let(around(parts), in_blocks))


def _is_ip(value: Column) -> Column:
    part = lambda p: _let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: F.when(F.length(d) <= 3, d.cast("int") <= 255).otherwise(False))
    return F.forall(F.split(value, r"\."), part)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_card(value: Column) -> Column:
    def luhn(digits: Column) -> Column:
        twice = F.translate(digits, "0123456789", "0246813579")
        sums = [F.substring(d, at, 1).cast("int") for at, d in zip(range(1, 21), [twice, digits] * 10, strict=True)]
        return sum(sums[1:], sums[0]) % 10 == 0

    return _let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _let(F.lpad(d, 20, "0"), luhn)).otherwise(False))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


#: Kind, pattern, what a match must pass, and the form in which two mentions of one entity are equal.
KINDS = (
    ("email", EMAIL, lambda v: F.lit(True), F.lower), ("ip", IP, _is_ip, lambda v: v),
    ("card", CARD, _is_card, _digits), ("phone", PHONE, _is_phone, _digits),
)


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `text` (null: empty) and one array of spans for each kind: n, start, end, value, left, right."""
    found = docs.withColumn("text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return found.withColumns({kind: _passing(matches(F.col("text"), pattern), ok) for kind, pattern, ok, _ in KINDS})


def _passing(spans: Column, ok: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: ok(s["value"]))


def _entities() -> Column:
    """All mentions of entities: (entity, left, right)."""
    def of(kind: str, same: Callable[[Column], Column]) -> Column:
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(f"{kind}:"), same(s["value"])).alias("entity"), s["left"].alias("left"), s["right"].alias("right")))

    return F.concat(*(of(kind, same) for kind, _, _, same in KINDS))


def terms_of(text: Column) -> Column:
    """Distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def beside(docs: DataFrame) -> DataFrame:
    """From the rows of with_base: (sha, entity, term, context, copies), each word beside an entity once for each text and
    different surroundings. copies: rows with that text. term is null where no word stands beside the entity."""
    mention = docs.where(" or ".join(f"size({kind}) > 0" for kind, *_ in KINDS)).select(F.unhex(F.sha2("text", 256)).alias("sha"), F.explode(F.array_distinct(F.transform(
        _entities(), lambda m: F.struct(m["entity"].alias("entity"), F.lower(F.concat(m["left"], F.lit(" "), m["right"])).alias("context")),
    ))).alias("m"))
    counted = mention.groupBy("sha", "m").agg(F.count("*").alias("copies"))
    return counted.select("sha", "m.entity", F.explode_outer(terms_of(F.col("m.context"))).alias("term"), F.xxhash64("m.context").alias("context"), "copies")


def disclosures(docs: DataFrame, near: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, documents_both, documents_term, documents_entity, information, disclosure) of the pairs seen in at least
    `contexts` different surroundings. docs: all rows with text, all of which count; near: what beside() found in them."""
    rows = near.groupBy("entity", "term", "sha").agg(F.max("copies").alias("copies"))
    both = rows.where("term is not null").groupBy("entity", "term").agg(F.sum("copies").alias("documents_both"))
    alone = rows.groupBy("entity", "sha").agg(F.max("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("documents_entity"))
    seen = near.where("term is not null").select("entity", "term", "context").distinct().groupBy("entity", "term").count().where(F.col("count") >= contexts).select("entity", "term")
    pairs = written(seen.join(both, ["entity", "term"]).join(alone, "entity"), "pairs")
    everywhere = docs.select(F.explode(terms_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("documents_term"))
    total = F.lit(float(docs.count()))
    information = F.log2(total / F.col("documents_entity"))
    return pairs.join(everywhere, "term").withColumn("information", information).withColumn(
        "disclosure", F.when(F.col("information") > 0, F.log2(total * F.col("documents_both") / (F.col("documents_term") * F.col("documents_entity"))) / F.col("information")).otherwise(0.0)
    )


def _named(kind: str, rank: int, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(f"[{kind}]").alias("instead")))


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Places of the words of terms (map: word to whether it is removed) that touch no span of base."""
    anywhere = F.concat(F.lit(f"(?iu)(?<!{_EDGE})(?:"), F.array_join(F.array_sort(F.map_keys(terms)), "|"), F.lit(f")(?!{_EDGE})"))
    free = lambda s: ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    general = lambda v: F.when(v.rlike("^[0-9]+$"), "[number]").when(v.rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    return F.transform(F.filter(matches(text, anywhere), free), lambda s: F.struct(
        s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("term").alias("kind"),
        F.when(F.coalesce(F.try_element_at(terms, F.lower(s["value"])), F.lit(False)), "").otherwise(general(s["value"])).alias("instead"),
    ))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts: int = CONTEXTS, least_bits: float = LEAST_BITS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base and spans (arrays of start, rank, end, kind,
    instead, by start and kind), sanitised (the text with each span replaced; overlapping spans are one).

    Null texts count as empty; empty texts have no spans; repeated rows and null ids give rows like others; an empty table
    gives none. Other columns are never read. Every match counts, however long the text. Words are sanitised in texts
    where they stand beside the entity that they reveal; texts without entities stay as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    based = with_base(rows)
    near = written(beside(based), "beside")
    telling = (
        disclosures(rows, near, contexts).where((F.col("information") >= least_bits) & (F.col("disclosure") >= generalise))
        .select("entity", "term", (F.col("disclosure") >= remove).alias("gone"))
    )
    found = near.where("term is not null").select("sha", "entity", "term").distinct().join(telling, ["entity", "term"])
    each = found.groupBy("sha", "term").agg(F.bool_or("gone").alias("gone")).groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("terms"))
    terms = written(each, "telling")
    base = F.array_sort(F.concat(*(_named(kind, rank, F.col(kind)) for rank, (kind, *_) in enumerate(KINDS))))
    slim = based.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("sha"), *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS), base.alias("base"))
    joined = slim.join(terms, "sha", "left")
    added = F.when(F.col("terms").isNotNull(), _term_spans(F.col("text"), F.col("terms"), F.col("base")))
    spans = joined.withColumn("spans", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", added))))
    return spans.select("doc_id", *(f"n_{kind}" for kind, *_ in KINDS), "base", "spans", _replaced(F.col("text"), F.col("spans")).alias("sanitised"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with what stands in place of each span; a span that begins inside the ones before adds to their length only."""

    def block_text(block: Column, begin: Column) -> Column:
        def add(state: Column, s: Column) -> Column:
            gap = F.substring(state["text"], (state["at"] - begin + 1).cast("int"), F.greatest(F.lit(0), s["start"] - state["at"]).cast("int"))
            out = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], F.array(gap, s["instead"])))
            return F.struct(state["text"].alias("text"), out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

        own = F.substring(text, (begin + 1).cast("int"), F.greatest(F.lit(0), _last(block) - begin).cast("int"))
        start = F.struct(own.alias("text"), F.array().cast("array<string>").alias("out"), begin.alias("at"))
        return F.aggregate(block, start, add, lambda s: F.array_join(s["out"], ""))

    def whole_text(blocks: Column) -> Column:
        ends = F.transform(blocks, _last)
        begins = _let(ends, lambda e: F.transform(e, lambda _, k: F.coalesce(F.array_max(F.slice(e, 1, k)), F.lit(0).cast("long"))))
        return F.concat(F.array_join(F.zip_with(blocks, begins, block_text), ""), F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_blocks(spans), whole_text))


def _last(block: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(0).cast("long"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_information_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
