"""Information-theoretic sanitisation of personal data (native DataFrame functions only).

Emails, IP addresses, card and phone numbers are the protected entities, and so are their groups: mail domains, networks
of 256 addresses, ranges of numbers. Corpus co-occurrence then tells how strongly a term (letters and digits, three or
more) reveals one: over all documents (rows), n(t) hold term t, n(e) hold e, and n(t,e) hold both. A term discloses e if
its normalised pointwise mutual information with e reaches ``threshold`` and e is at least as likely as not where t
stands, n(t,e) discounted by ``DISCOUNT`` in both; an entity of one text counts too. Every occurrence of a disclosing
term beside the base spans becomes a span of kind ``term``, in whichever document it stands.

Scale: one scan finds the entities (a row per document; only those with an entity keep their terms). n(t) is a map-side
combined count of distinct terms per document. Entities that stand in the same documents are one class, so a log of
many addresses meets its terms once and not once an address; a bound on n(t) that follows from n(e) drops most terms
before joint counts. Documents that hold a disclosing term come from a join on terms, and their texts are joined to
those alone; their words are matched as rows. Places of a text's matches come from blocked prefix sums, near linear.

Defined cases: null text is empty; repeated rows and equal ids with different texts are kept apart by a hash of the text; an empty
table or a corpus without entities gives no term spans; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import find_all, let, replaced, text_of

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive and guarded on the left, so that no run of characters is scanned from each of its positions.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Taken off every joint count: chance meetings weigh less, and an entity that stands in one text still has its terms.
DISCOUNT = 0.5
TERM = r"[\p{L}\p{N}]{3,}"
#: Frequent terms that are left out before rows are shuffled; none could disclose, so results are the same.
COMMON = 4096


def _luhn(digits: Column) -> Column:
    right = F.reverse(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = lambda i: F.substring(right, i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(right)), lambda i: F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(v, r"\."), lambda p: part(p) & small(p))
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind: array<struct<s, e, v>>, in code points, end exclusive."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]
    found = find_all(text, PATTERNS[kind])
    if kind != "email":
        found = F.filter(found, lambda x: _valid(kind, x["v"]))
    return F.when(hint, found).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,v:string>>"))


def _names(kind: str, v: Column) -> list[Column]:
    """Names of the entity, one for all spellings, and of the group that a part of it stands for: an address's domain, a
    network of 256, the first six digits of a number."""
    if kind == "email":
        return [F.concat(F.lit("email:"), F.lower(v)), F.concat(F.lit("domain:"), F.lower(F.substring_index(v, "@", -1)))]
    if kind == "ip":
        return [F.concat(F.lit("ip:"), v), F.concat(F.lit("network:"), F.substring_index(v, ".", 3))]
    digits = F.regexp_replace(v, "[^0-9]", "")
    return [F.concat(F.lit(f"{kind}:"), digits), F.concat(F.lit(f"{kind} range:"), F.substring(digits, 1, 6))]


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda v: F.lower(v)))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), spans: array<struct<kind, s, e>> of the base kinds, and of a document with spans also
    keys: hashed names of its entities and their groups, terms: its different terms."""

    def one(t: Column, k: int, kind: str) -> Column:
        hashed = lambda x: F.array(*[F.xxhash64(name) for name in _names(kind, x["v"])])
        return F.transform(base_spans(t, kind), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), hashed(x).alias("keys")))

    t = F.col("t")
    plain = lambda x: F.transform(x, lambda y: F.struct(y["kind"].alias("kind"), y["s"].alias("s"), y["e"].alias("e")))
    found = F.concat(*[one(t, k, kind) for k, kind in enumerate(KINDS[:4])])
    both = let(found, lambda x: F.struct(plain(x).alias("spans"), F.array_distinct(F.flatten(F.transform(x, lambda y: y["keys"]))).alias("keys"), F.when(F.size(x) > 0, _terms(t)).alias("terms")))
    return docs.select("doc_id", text_of("text").alias("t")).select("doc_id", F.xxhash64("t").alias("h"), both.alias("x")).select("doc_id", "h", "x.spans", "x.keys", "x.terms")


def _npmi(n: Column) -> Column:
    """Of n_te, n_t and n_e out of ``n`` documents, the joint count of the numerator discounted. What stands in every
    document tells nothing."""
    pmi = F.log((F.col("n_te") - DISCOUNT) * n / (F.col("n_t").cast("double") * F.col("n_e")))
    return F.when(F.col("n_te") >= n, 0.0).otherwise(pmi / -F.log(F.col("n_te") / n))


def disclosing(docs: DataFrame, found: DataFrame, threshold: float = 0.8, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(terms, common). Terms: cls, t, n_te, n_t, n_e, npmi of those that disclose an entity or group; ``cls`` stands for
    all entities of the same set of documents, ``least`` is the least share of a term's documents that have one. Common:
    the at most COMMON most frequent terms, in too many documents to disclose any. ``found``: what entities() gave for
    ``docs``, written out."""
    held = found.filter(F.size("keys") > 0).select(F.xxhash64("doc_id", "h").alias("d"), "keys", "terms")
    half = lambda x: [F.sum(x.bitwiseAND(F.lit((1 << 32) - 1))), F.sum(F.shiftrightunsigned(x, 32))]
    sums = held.select("d", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n_e"), *[c.alias(f"sum{k}") for k, c in enumerate(half(F.col("d")))])
    n_e = shared.table(sums.select("key", "n_e", F.xxhash64("n_e", "sum0", "sum1").alias("cls")), "disclosure-classes")
    n, most = float(found.count()), n_e.agg(F.max("n_e")).first()[0]
    if not most:
        none = n_e.select("cls", F.lit("").alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("n_te", "n_t")], "n_e", F.lit(0.0).alias("npmi")).limit(0)
        return none, none.select("t")
    # As n_te <= n_e, a term in more documents than this is never likely to have the entity beside it.
    room = lambda e: (e - DISCOUNT) / least
    counts = shared.table(docs.select(F.explode(_terms(text_of("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")), "disclosure-counts")
    n_t = counts.filter(F.col("n_t") <= room(F.lit(float(most))))
    common = shared.table(counts.filter(F.col("n_t") > room(F.lit(float(most)))).orderBy(F.desc("n_t"), "t").limit(COMMON).select("t"), "disclosure-common")
    row = held.withColumn("row", F.monotonically_increasing_id()).select("row", "keys", "terms")
    row = shared.table(row, "disclosure-held")
    classes = row.select("row", F.explode("keys").alias("key")).join(n_e, "key").groupBy("row").agg(F.collect_set(F.struct("cls", "n_e")).alias("classes"))
    beside = row.join(classes, "row").select("classes", F.explode("terms").alias("t")).join(F.broadcast(common), "t", "left_anti").join(n_t, "t")
    beside = beside.select("t", "n_t", F.explode(F.filter("classes", lambda c: F.col("n_t") <= room(c["n_e"]))).alias("c"))
    joint = beside.groupBy("c.cls", "t").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("c.n_e").alias("n_e"))
    likely = F.col("n_te") - DISCOUNT >= least * F.col("n_t")
    return joint.filter(likely).withColumn("npmi", _npmi(F.lit(n))).filter(F.col("npmi") >= threshold), common


def find(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, h, base and added: arrays of struct<s, kind, e> in order; kind indexes KINDS."""
    kind = "array<struct<s:bigint,kind:int,e:bigint>>"
    found = shared.table(entities(docs), "disclosure-entities")
    base = F.sort_array(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))).cast(kind)
    based = found.select("doc_id", "h", base.alias("base"))
    terms, common = disclosing(docs, found, threshold)
    revealing, common = shared.table(terms.select("t").distinct(), "disclosure-terms"), F.broadcast(common)  # COMMON words at most
    text, same = text_of("text"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    held = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("g"), F.explode(_terms(text)).alias("t"))
    hits = shared.table(held.join(common, "t", "left_anti").join(revealing, "t", "left_semi").select("d", "g").distinct(), "disclosure-hits")
    own = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).join(hits, same).select("d", "g", "text").dropDuplicates(["d", "g"])
    own = own.join(based.dropDuplicates(["doc_id", "h"]), same)
    bare = F.when(F.size("base") > 0, replaced(F.col("text"), F.col("base"), lambda x, n, whole: F.repeat(F.lit(" "), n.cast("int")))).otherwise(F.col("text"))
    words = own.select("d", "g", F.explode(find_all(bare, TERM)).alias("x")).select("d", "g", "x.s", "x.e", F.lower("x.v").alias("t"))
    marked = words.join(common, "t", "left_anti").join(revealing, "t", "left_semi").groupBy("d", "g").agg(F.sort_array(F.collect_list(F.struct("s", F.lit(4).alias("kind"), "e"))).cast(kind).alias("added"))
    return based.join(marked, same, "left").select("doc_id", "h", "base", F.coalesce("added", F.array().cast(kind)).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitise(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with protected entities generalised to their kind and disclosing terms removed from ``text``."""
    spans = find(docs, threshold).select(F.col("doc_id").alias("tidewatch_d"), F.col("h").alias("tidewatch_g"), F.sort_array(F.concat("base", "added")).alias("tidewatch_spans"))
    spans = spans.filter(F.size("tidewatch_spans") > 0).dropDuplicates(["tidewatch_d", "tidewatch_g"])
    own = docs.withColumn("tidewatch_h", F.xxhash64(text_of("text")))
    rows = own.join(spans, F.col("doc_id").eqNullSafe(F.col("tidewatch_d")) & (F.col("tidewatch_h") == F.col("tidewatch_g")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit("[...]"))
    text = F.col("text")
    rebuilt = replaced(text, F.col("tidewatch_spans"), lambda x, n, whole: F.when(whole, F.get(names, x["kind"])).otherwise(""))
    return rows.withColumn("tidewatch_text", F.when(F.col("tidewatch_spans").isNull(), text).otherwise(rebuilt)).select(*[F.col("tidewatch_text").alias(c) if c == "text" else F.col(c) for c in docs.columns])
