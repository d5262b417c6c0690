"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is what stands between newlines; blank lines are kept and never compared. Of each set of equal lines the earliest
(by ``doc_id``, then place) stays, and so does a line no earlier one is within the edit bound of: one word inserted,
deleted or replaced, for lines of ``LEAST_WORDS`` words or more, which leaves at least four words in five alike, the
least likeness that counts.
Shorter lines are compared for equality. Words are what single blanks separate. A line also goes if the earlier line it
is near to goes itself, as in any class of copies the earliest of which stays: of a chain of lines, each one word from
the one before, only the first is kept, though its ends may be several words apart.

Steps. Equal lines meet by a 128-bit hash, combined before the shuffle. Each distinct line gives keys of its halves, cut
where a partner of its own length or one word shorter would be cut: one edit leaves a half as it is, so lines
whose halves nobody shares have no partner. The others emit hashed variants with one word deleted (a replaced word: the
same place deleted in both; an inserted word: deleted in the longer line, nothing in the shorter), equal
variants are joined to the earliest line that has them, and the edit distance to that line is verified. All lines that
share a variant with a given place are one edit apart from each other, and a shorter line is one edit from
each longer one that shares its words, so meeting the earliest of a key settles it: no pairs within a key are made.

The rows of a document are its own text's, so it is cut and put together again in place; only the numbers of lines to
drop are joined to it.

Defined cases: null text stays null; a text all of whose lines go becomes empty; rows with a null ``doc_id`` are left
as they are and neither give nor lose lines; rows that repeat an id and a text all lose the same lines, and equal ids
with different texts count as one document whose lines come in the order of the texts; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffled

#: Words from which a line may differ by one word from an earlier one.
LEAST_WORDS = 5
#: Keys of 8 bytes that a broadcast may have: 4 MB.
BROADCAST_KEYS = 500_000


def _hashes() -> tuple[Column, Column]:
    """The two halves of a line's 128-bit hash."""
    return F.xxhash64("line"), F.xxhash64(F.lit(7), "line")


def _words() -> Column:
    return F.split("line", " ", -1)


def _half_keys() -> Column:
    """Hashes of the head and tail of a line for partners of the same length, and for those of one word less; cut at
    blanks in place, without an array of words."""
    n = F.col("n")

    def pair(base: Column) -> list[Column]:
        head = F.floor(base / 2).cast("int")
        ends = ((1, head), (2, head - base))
        return [F.xxhash64(F.lit(k), base, F.call_function("substring_index", F.col("line"), F.lit(" "), count)) for k, count in ends]

    return F.when(n >= LEAST_WORDS, F.array(*pair(n), *pair(n - 1)))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, place, line) of all lines that aren't blank; ``version`` tells texts of one id apart."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    cut = rows.select("doc", F.xxhash64("t").alias("version"), F.posexplode(F.split("t", "\n", -1)).alias("place", "line"))
    return cut.where(F.trim("line") != "")


def distinct_lines(places: DataFrame) -> DataFrame:
    """(h1, h2, first, n, keys): each distinct line, its earliest place and how many places it has."""
    first = F.min(F.struct("doc", "version", "place")).alias("first")
    return places.groupBy("h1", "h2").agg(first, F.count("*").alias("n"), F.first("keys").alias("keys"))


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is among the distinct ``keys``: by a broadcast up to BROADCAST_KEYS of them, counted
    first, and by a join of both sides' shuffles beyond. Both keep the same rows."""
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, key, "left_semi")


def with_company(distinct: DataFrame) -> DataFrame:
    """(h1, shared): lines that share a half with another line; ``shared``: which of the four keys.

    Lines are told apart by ``h1`` here; should two share it, both are candidates, and only that.
    """
    keys = distinct.where("keys is not null").select("h1", F.posexplode("keys").alias("which", "key"))
    # both lengths' keys of a line can be equal only by chance, so a count above one means another line
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"))
    return materialise(among(keys, shared, "key").groupBy("h1").agg(F.collect_set("which").alias("shared")))


def texts_of(docs: DataFrame, company: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """(h1, h2, first, shared, line) of the lines in ``company``, each from its earliest place."""
    h1, h2 = _hashes()
    lines = lines_of(docs, key, text).withColumns({"h1": h1, "h2": h2})
    found = among(lines, company.select("h1"), "h1").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    return found.join(company, "h1").join(distinct.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "first", "shared", "line")


def variants(lines: DataFrame) -> DataFrame:
    """(h1, h2, kind, key): the deletion neighbourhood of lines with company.

    Kind 0: one word deleted, its place and the length being part of the key; 1: all words; 2: one word deleted, by
    the words alone. Only places in the half that isn't shared can be the edit's.

    A sequence of words is hashed as the xor of its words' hashes, each taken with its place, so no variant is ever
    spelled out: a word deleted takes its hash away and moves the words after it up by one place, and a running xor
    along the line has the hashes of all its variants, in time linear in its words.
    """
    n = F.size("words")
    words = lines.repartition("h1", "h2").withColumn("words", _words()).select("h1", "h2", "shared", n.alias("n"), F.posexplode("words").alias("at", "word"))
    i = F.col("at") + 1
    placed = words.select("h1", "h2", "shared", "n", i.alias("i"), F.xxhash64("word", i).alias("here"), F.xxhash64("word", i - 1).alias("moved"))
    line = Window.partitionBy("h1", "h2")
    before = line.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    hashed = placed.select(
        "*",
        F.bit_xor("here").over(line).alias("all"),
        F.bit_xor("moved").over(line).alias("all_moved"),
        # words before stay in place: in the hash of all words moved they count as here instead
        F.coalesce(F.bit_xor(F.col("here").bitwiseXOR(F.col("moved"))).over(before), F.lit(0).cast("long")).alias("stay"),
    )
    at = lambda k: F.array_contains("shared", F.lit(k))
    head, shorter = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    replaced = (at(0) & (F.col("i") > head)) | (at(1) & (F.col("i") <= head))
    deleted = (at(2) & (F.col("i") > shorter)) | (at(3) & (F.col("i") <= shorter + 1))
    without = F.col("all_moved").bitwiseXOR(F.col("stay")).bitwiseXOR(F.col("moved"))
    kind = lambda k, key: F.struct(F.lit(k).alias("kind"), key.alias("key"))
    keys = F.array(
        F.when(replaced, kind(0, F.xxhash64("n", "i", F.col("all").bitwiseXOR(F.col("here"))))),
        F.when(F.col("i") == 1, kind(1, F.col("all"))),
        F.when(deleted, kind(2, without)),
    )
    return hashed.select("h1", "h2", F.explode(F.array_compact(keys)).alias("v")).select("h1", "h2", "v.kind", "v.key")


def _one_edit(a: str, b: str) -> Column:
    """Whether the word arrays are within one insertion, deletion or replacement: what is alike at both ends covers all
    but one word of either."""
    x, y = F.col(a), F.col(b)
    short = F.least(F.size(x), F.size(y))
    alike = F.transform(F.sequence(F.lit(0), short - 1), lambda i: x[i] == y[i])
    stop = F.array_position(alike, False)
    head = F.when(stop == 0, short).otherwise(stop - 1).cast("int")
    same_length = F.size(F.filter(F.arrays_zip(x.alias("p"), y.alias("q")), lambda z: z["p"] != z["q"])) <= 1
    longer, other = F.when(F.size(x) > F.size(y), x).otherwise(y), F.when(F.size(x) > F.size(y), y).otherwise(x)
    spliced = F.concat(F.slice(longer, 1, head), F.slice(longer, head + 2, F.size(longer)))
    return F.when(F.size(x) == F.size(y), same_length).otherwise((F.abs(F.size(x) - F.size(y)) == 1) & (spliced == other))


def near_later(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2) of lines one edit away from an earlier line.

    A line meets the earliest one of each of its keys; each such pair once is verified on the words.
    """
    # a key of one line alone meets nobody; all words (kind 1) and one word deleted (kind 2) meet each other
    met = keyed.withColumn("meets", F.xxhash64(F.col("kind") == 0, "key"))
    shared = materialise(met.groupBy("meets").agg(F.count("*").alias("k")).where("k > 1").select("meets"))
    met = materialise(among(met, shared, "meets").join(lines.select("h1", "h2", "first"), ["h1", "h2"]))
    least = met.groupBy("key", "kind").agg(F.min(F.struct("first", "h1", "h2")).alias("r"))
    other = F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind"))
    partner = least.select("key", other.alias("kind"), "r")
    pairs = met.join(shuffled(partner), ["key", "kind"]).where("r.first < first").select("h1", "h2", F.col("r.h1").alias("r1"), F.col("r.h2").alias("r2")).distinct()
    words = lines.select("h1", "h2", _words().alias("x"))
    theirs = lines.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), _words().alias("y"))
    return pairs.join(shuffled(words), ["h1", "h2"]).join(shuffled(theirs), ["r1", "r2"]).where(_one_edit("x", "y")).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, version, drop): the places, from 0, of the lines that each text loses."""
    h1, h2 = _hashes()
    blanks = F.octet_length("line") - F.octet_length(F.call_function("replace", "line", F.lit(" "), F.lit("")))
    hashed = lines_of(docs, key, text).select("doc", "version", "place", "line", h1.alias("h1"), h2.alias("h2"), (blanks + 1).alias("n"))
    places = hashed.select("doc", "version", "place", "h1", "h2", _half_keys().alias("keys"))
    distinct = materialise(distinct_lines(places))
    company = with_company(distinct)
    candidates = materialise(texts_of(docs, company, distinct, key, text))
    near = near_later(materialise(variants(candidates)), candidates)
    repeated = distinct.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "first", "near")
    repeated = materialise(repeated)  # read anew, both sides of the next join are plain shuffles, so a hot line can be split
    gone = places.drop("keys").join(repeated, ["h1", "h2"]).where(F.col("near") | (F.struct("doc", "version", "place") != F.col("first")))
    return gone.groupBy("doc", "version").agg(F.collect_set("place").alias("drop"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with later equal and near-equal lines taken out of ``text``; all columns and rows stay."""
    drop = dropped_lines(docs, key, text).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("drop").alias("__drop"))
    joined = docs.join(drop, (docs[key] == F.col("__doc")) & (F.xxhash64(docs[text]) == F.col("__version")), "left")
    # the places that stay are a difference of sets, and a text is split once, so a document of very many lines costs no more than they are
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    rest = lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")
    kept = F.get(F.transform(F.array(F.split(docs[text], "\n", -1)), rest), F.lit(0))
    columns = [F.when(F.col("__drop").isNull(), docs[c]).otherwise(kept).alias(c) if c == text else docs[c] for c in docs.columns]
    return joined.select(*columns)
