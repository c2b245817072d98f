"""Personal data, in DataFrame functions only: patterns, and terms that give away what they stand near.

Base: e-mail addresses, IP addresses, card numbers with a valid check digit, and phone numbers. The values
found are the protected entities. Over all documents, the information that a term holds about an entity
is estimated from how often it stands near it: PMI(entity, term) = log2(p(entity | term) / p(entity)), out
of the entity's information content IC = -log2 p(entity). Terms that disclose at least a share `generalise`
of it are generalised wherever they occur, and from `remove` on they are removed. Near is within `width`
characters. An entity and a pair count only with `support` different contexts in as many distinct texts; an
entity that is seen less often gives no estimate, so only its own mentions are protected. All probabilities
are shares of distinct texts, so copies of a text are evidence neither for nor against.

An estimate of at least g needs n_term <= n_both * (n_docs / n_entity) ** (1 - g). How many texts have a term
beside any entity is a lower bound of n_term, so common words are ruled out before the corpus is counted.

Positions come from cutting a text at the matches: pieces and matches in turn add up to code points.
Patterns take time in proportion to the text: a run of letters that can't begin a match is tried once.

Null text is empty and has no spans. Terms join by text, so null or repeated doc_ids don't matter. Copies
and repeated rows give equal results. Spans of different kinds may overlap; when redacted, they are
merged. An empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlake.llm.common import only, written

#: Fixed patterns. \G stands where the last match ended: there a match may begin within a run as well.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
WORD = r"\p{L}[\p{L}\p{N}_]{2,}"

CONTEXT = 120
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
TOKENS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def matches(text: Column, pattern: Column | str) -> Column:
    """Leftmost non-overlapping matches as an array of (s, e, v): code points, end exclusive, and text."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("v")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = (start + F.length(x["v"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("int").alias("s"), end.alias("e"), x["v"].alias("v")))).alias("out"))

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, placed).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check: each second from the right counts double, less nine if over nine."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def part_fits(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of (s, e, v) by kind."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    n = lambda x: F.length(digits(x["v"]))
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.filter(matches(text, IP), lambda x: F.forall(F.split(x["v"], r"\."), part_fits)),
        "card": F.filter(matches(text, CARD), lambda x: F.when(n(x).between(13, 19), luhn(digits(x["v"]))).otherwise(False)),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda x: n(x).between(9, 15))).otherwise(none),
    }


def _found(docs: DataFrame) -> DataFrame:
    """docs with text (never null) and the base spans: _email, _ip, _card, _phone."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return out.withColumns({f"_{k}": c for k, c in base_spans(F.col("text")).items()})


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _entity(kind: str):
    """A span with its value in one form."""

    def named(x: Column) -> Column:
        value = F.lower(x["v"]) if kind in ("email", "ip") else digits(x["v"])
        return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("entity"), x["s"].alias("s"), x["e"].alias("e"))

    return named


def contexts(docs: DataFrame, width: int = CONTEXT) -> DataFrame:
    """Mentions of entities in distinct texts: entity, key of the text, context (a hash of what stands up to width
    characters to either side) and the words in it."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    kinds = [F.transform(f"_{k}", _entity(k)) for k in KINDS]
    mentions = _found(only(docs, "text")).select("text", key.alias("key"), F.explode(F.concat(*kinds)).alias("m"))
    # Whole words to either side: what the cut leaves of a word is dropped.
    before = F.when(F.col("m.s") <= width, F.substring("text", F.lit(1), F.col("m.s"))).otherwise(F.regexp_replace(F.substring("text", F.col("m.s") - width + 1, F.lit(width)), r"^[\p{L}\p{N}_]+", ""))
    after = F.regexp_replace(F.substring("text", F.col("m.e") + 1, F.lit(width)), r"[\p{L}\p{N}_]+$", "")
    near = F.concat(before, F.lit(" \n "), after)
    return mentions.select("m.entity", "key", F.xxhash64(near).alias("context"), _words(near).alias("terms")).distinct()


def disclosing_terms(docs: DataFrame, width: int = CONTEXT, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """Terms that give an entity away: term, and the largest share of an entity's information."""
    # Every count is one of distinct texts. Rows of a text that occurs k times weigh 1 / k each, so that no text
    # has to be brought together with its copies.
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = written(only(docs, "text").groupBy(key.alias("key")).agg(F.count("*").alias("copies")), "texts")
    n_docs = texts.count()
    seen = written(contexts(docs, width), "contexts")
    enough = F.least(F.count_distinct("context"), F.count_distinct("key")) >= support
    entities = seen.groupBy("entity").agg(F.count_distinct("key").alias("n_entity"), enough.alias("enough")).where("enough").drop("enough")
    beside = seen.select("entity", "key", "context", F.explode("terms").alias("term"))
    pairs = beside.groupBy("entity", "term").agg(F.count_distinct("key").alias("n_both"), enough.alias("enough")).where("enough").drop("enough")
    # A term can't be in fewer texts than it is beside entities in; what this rules out needn't be counted.
    near = beside.groupBy("term").agg(F.count_distinct("key").alias("n_near"))
    most = F.col("n_both") * F.pow(n_docs / F.col("n_entity"), F.lit(1 - generalise)) * (1 + 1e-9)
    pairs = written(pairs.join(written(entities, "entities"), "entity").withColumn("most", most), "pairs")
    pairs = written(pairs.join(near, "term").where("n_near <= most").drop("n_near"), "pairs")
    terms = written(pairs.groupBy("term").agg(F.max("most").alias("most")), "terms")
    again = written(texts.where("copies > 1"), "copies")
    own = only(docs, "text").withColumn("key", key).join(again, "key", "left")
    own = own.select((1 / F.coalesce("copies", F.lit(1))).alias("weight"), F.explode(_words(F.coalesce("text", F.lit("")))).alias("term"))
    # Counted before they are joined: each task combines its rows to one a term.
    counts = own.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("n_term"))
    counts = written(counts.join(terms, "term").where("n_term <= most").select("term", "n_term"), "counts")
    information = -F.log2(F.least(F.lit(1.0), F.col("n_entity") / n_docs))
    pmi = F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")) * n_docs / F.col("n_entity"))
    shares = pairs.join(counts, "term").withColumn("share", F.when(information > 0, pmi / information).otherwise(0.0))
    return written(shares.groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise), "disclosing")


def _term_spans(docs: DataFrame, width: int, support: int, generalise: float, remove: float) -> DataFrame:
    """_found(docs) with _term: spans of disclosing terms, v the term in lower case, and _removed: the terms
    to be removed rather than generalised."""
    terms = disclosing_terms(docs, width, support, generalise)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    own = only(docs, "text").select(key.alias("_key"), F.explode(_words(F.coalesce("text", F.lit("")))).alias("term"))
    own = own.join(terms, "term").groupBy("_key").agg(F.sort_array(F.collect_set("term")).alias("_terms"), F.collect_set(F.when(F.col("share") >= remove, F.col("term"))).alias("_removed"))
    out = docs.withColumn("_key", key).join(written(own, "own"), "_key", "left").drop("_key")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}_])"))
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return _found(out).withColumn("_term", F.when(F.col("_terms").isNotNull(), matches(F.col("text"), pattern)).otherwise(none))


def _listed(kinds: tuple[str, ...]) -> Column:
    def named(kind: str):
        return lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))

    return F.array_join(F.concat(*(F.transform(f"_{k}", named(k)) for k in kinds)), ",")


def scan(docs: DataFrame, width: int = CONTEXT, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """A row for each document (doc_id, text): counts of the base kinds, digest of the base spans, all spans."""
    found = _term_spans(only(docs, "doc_id", "text"), width, support, generalise, remove)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*KINDS, "term")).alias("spans"), F.size("_term").cast("long").alias("n_term"))


def redacted() -> Column:
    """The text of a row of _term_spans() with its spans replaced; spans that overlap become one."""
    def token(to: str):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(to).alias("to"))

    spans = [F.transform(f"_{k}", token(TOKENS[k])) for k in KINDS]
    kind = lambda v: F.when(v.rlike("[0-9]"), "[CODE]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    spans.append(F.transform("_term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(F.array_contains(F.coalesce("_removed", F.array().cast("array<string>")), F.lower(x["v"])), "").otherwise(kind(x["v"])).alias("to"))))
    kind_of = "array<struct<s:int,e:int,to:string>>"

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["to"].alias("to"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] > x["s"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.array_sort(F.concat(*spans)), F.array().cast(kind_of), merge)
    text = F.col("text")
    # Each part is the text since the span before, and what stands for the span.
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda x: x["e"]))
    parts = F.zip_with(F.slice(ends, F.lit(1), F.size(merged)), merged, lambda at, x: F.concat(F.substring(text, at + 1, x["s"] - at), x["to"]))
    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    every = reduce(lambda a, b: a + b, (F.size(f"_{k}") for k in (*KINDS, "term")))
    return F.when(every > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(text)


def sanitise(docs: DataFrame, width: int = CONTEXT, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with text redacted and n_chars its length; other columns as they are. Null text stays null."""
    # The row travels as one value, so its columns' names clash with none used here.
    found = _term_spans(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), F.col("text")), width, support, generalise, remove)
    text = F.when(F.col("_all.text").isNotNull(), redacted())
    out = found.select("_all", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_all.n_chars"))
    return out.select(*(new.get(c, F.col(f"_all.`{c}`")).alias(c) for c in docs.columns))
