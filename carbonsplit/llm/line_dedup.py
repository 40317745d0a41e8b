"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words.  Lines with equal sets form a class, and the
join runs over classes.  Words are ordered by rarity; two sets that are similar enough
share a word among their first few (prefix filter), so those words are the join key.
Of two sets the one with fewer words is looked up by fewer of them than the other.
The key of the join holds a class of sizes beside the word, so that sets of very unlike
sizes do not meet.  Length and position of the shared word and a bitmap of the set, of twice the bits for the
longer lines, refuse nearly all other pairs in the join itself, a bitmap of twice the bits
again most of what is left; the rest is verified on the words.

Only whether a class has an earlier match is asked.  So that a group of near copies is
not compared pair by pair, each class is first compared with the earliest class that
shares a hash key with it, and the rest with those classes that many were matched with
that way; those that match are settled and no longer search in the join.  They are still found
there by others, so no match is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from carbonsplit.llm.common import is_small, keep_last, settle, small
from carbonsplit.sources.shared import release_tables, written_tables

#: Counters of word frequency; words that share one count as equally rare, which changes no result.
RARITY_COUNTERS = 1 << 16
#: Bits of a word's hash that are kept beside its rarity.
_KEY_BITS = 55
_POS_BITS = 31
#: Sets of so many words have a bitmap of 128 bits: on 64 too many words fall on each other.
WIDE_FROM = 48
#: Sets of so many words have a wide bitmap beside it: on 128 bits too many words fall on each other.
WIDER_FROM = 160
#: Numbers of 64 bits in a wide bitmap.
WIDE = 4
#: Between them lie the quarters of all hashes, in which the bitmaps are made.
_QUARTERS = (-(1 << 62), 0, 1 << 62)
#: So many matches by hash keys make a class a center; what fewer can miss is left to the join.
CENTER_FROM = 8
#: Parts in which the postings are joined.
POSTING_ROUNDS = 2
#: Parts in which pairs are verified at most.
ROUNDS = 4
#: Pairs that are verified in one part.
PAIRS_PER_ROUND = 200_000
_PLACE = ("doc_id", "text_key", "line_no")


def _document_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")]


def _folded(text: Column) -> Column:
    """Lower case, with a blank for every white space but the line feed."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    folded = lower
    for space in "\t\x0b\x0c\r":
        folded = F.replace(folded, F.lit(space), F.lit(" "))
    # few texts have any of them, and to see that takes less than to replace none
    odd = reduce(or_, [F.contains(F.coalesce(text, F.lit("")), F.lit(space)) for space in "\t\x0b\x0c\r"])
    return F.when(odd, folded).otherwise(lower)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _counter(word: Column) -> Column:
    return word.bitwiseAND(F.lit(RARITY_COUNTERS - 1))


def line_words(docs: DataFrame) -> DataFrame:
    """One row per line that has words: place, class (``sig``) and ``words``, the sorted hashes of its words, each once.

    Sets are told apart by ``sig``, 64 bits of all their words.  ``ends`` says how many
    words lie below each of ``_QUARTERS``.
    """
    lines = docs.select(*_document_key(), F.posexplode(F.split(_folded(F.col("text")), "\n")).alias("line_no", "line"))
    hashes = F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))
    # blank lines go before their words are cut: a filter on the words would cut them twice
    marks = F.array(*[F.lit(x).cast("long") for x in _QUARTERS])
    marked = lines.filter(F.trim("line") != "").select(*_PLACE, F.sort_array(F.concat(F.array_distinct(hashes), marks)).alias("marked"))
    # a mark stands behind the words below it and the marks before it
    ends = F.array(*[(F.array_position("marked", F.lit(x).cast("long")) - k - 1).cast("int") for k, x in enumerate(_QUARTERS)])
    sets = marked.select(*_PLACE, ends.alias("ends"), _without_marks(F.col("marked")).alias("words"))
    return sets.select(*_PLACE, F.xxhash64("words").alias("sig"), "ends", "words")


def _without_marks(marked: Column) -> Column:
    return reduce(lambda words, x: F.array_remove(words, F.lit(x).cast("long")), _QUARTERS, marked)


def _rarity(lines: DataFrame) -> Column:
    """For each counter in how many lines its words occur, in steps of a fourth of a doubling.

    The counters are all that comes to the driver, and their number is fixed.
    """
    counts = lines.select(F.explode("words").alias("word")).groupBy(_counter(F.col("word")).alias("at")).count()
    steps = [0] * RARITY_COUNTERS
    for row in counts.collect():
        steps[row["at"]] = int(4 * math.log2(row["count"])) + 1
    # one literal: a string that Spark turns into an array once
    return F.split(F.lit(",".join(map(str, steps))), ",").cast("array<long>")


def _needed(similarity: int, a: Column, b: Column) -> Column:
    """Words that sets of ``a`` and ``b`` words must share for a Jaccard similarity in percent."""
    return F.ceil((a + b) * similarity / (100 + similarity) - F.lit(1e-9))


def signatures(docs: DataFrame, similarity: int) -> DataFrame:
    """One row per line that has words, by place: class (``sig``, ``bits``, ``half``, ``wide``, ``n`` words) and ``prefix``."""
    lines = settle(line_words(docs), "word-hashes")
    return described(lines, _rarity(lines), similarity).orderBy(*_PLACE)


def described(lines: DataFrame, rarity: Column, similarity: int) -> DataFrame:
    """Rows of ``line_words`` with ``bits``, ``half``, ``wide``, ``n`` words and ``prefix`` instead of the words.

    A word is a number that sorts by rarity first and then by its hash.  ``bits`` has the
    parity of words per hash bit, so two sets differ in at least as many words as their
    bitmaps differ in bits; ``half`` with ``bits`` is the same over twice as many bits,
    ``wide`` over four times as many, null for lines too short to need them.  ``prefix``
    are the rarest words, of which a similar line must share one.
    """
    low = F.lit((1 << _KEY_BITS) - 1)
    none = F.lit(0).cast("long")

    def ranked(word: Column) -> Column:
        # never null, so that the numbers are sorted as they are and not as objects
        return F.coalesce(F.shiftleft(F.get(rarity, _counter(word)), _KEY_BITS).bitwiseOR(word.bitwiseAND(low)), none)

    # the bitmaps of the quarters are made first: each word is looked at once for all of them
    borders = [F.lit(0), *[F.get("ends", F.lit(k)) for k in range(WIDE - 1)], F.size("words")]
    quarters = [_parity(F.slice("words", low_end + 1, high_end - low_end)).alias(f"q{k}") for k, (low_end, high_end) in enumerate(pairwise(borders))]
    sets = lines.select(*_PLACE, "sig", *quarters, F.sort_array(F.transform("words", ranked)).alias("words"))
    n = F.size("words")
    keep = n - F.ceil(n * similarity / 100 - F.lit(1e-9)).cast("int") + 1
    quarter = [F.col(f"q{k}") for k in range(WIDE)]
    return sets.select(
        *_PLACE,
        "sig",
        reduce(Column.bitwiseXOR, quarter).alias("bits"),
        F.when(n >= WIDE_FROM, quarter[1].bitwiseXOR(quarter[3])).alias("half"),
        F.when(n >= WIDER_FROM, F.array(*quarter)).alias("wide"),
        n.alias("n"),
        F.slice("words", F.lit(1), keep).alias("prefix"),
    )


def with_keys(classes: DataFrame) -> DataFrame:
    """``keys``: hashes of a few rare words, in an order of their own, so that a word that comes or goes moves few others."""
    mixed = F.sort_array(F.transform("prefix", lambda w: F.xxhash64(w)))
    last_two = F.slice("mixed", F.greatest(F.size("mixed") - 1, F.lit(1)), F.lit(2))
    ends = F.xxhash64(F.element_at("mixed", 1), F.element_at("mixed", -1))
    keys = F.array_distinct(F.array(F.xxhash64(F.slice("mixed", 1, 2), F.lit(1)), F.xxhash64(last_two, F.lit(2)), ends))
    return classes.withColumn("mixed", mixed).withColumn("keys", keys).drop("mixed")


def _parity(words: Column) -> Column:
    """For each hash bit the parity of the words that fall on it."""
    one = F.lit(1).cast("long")

    def bit(word: Column) -> Column:
        # of the distance a shift takes the last six bits
        return F.call_function("shiftleft", one, F.shiftright(word, 40).cast("int"))

    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(bit(w)))


def _may_match(similarity: int, n: Column, bits: Column, other_n: Column, other_bits: Column) -> Column:
    """Length and bitmap filter: false only if the similarity cannot be reached."""
    apart = F.bit_count(bits.bitwiseXOR(other_bits))
    return (F.least(n, other_n) * 100 >= F.greatest(n, other_n) * similarity) & (apart <= n + other_n - _needed(similarity, n, other_n) * 2)


def _halves_may_match(similarity: int, n: Column, other_n: Column) -> Column:
    """The same by the bitmaps' halves, of postings ``a`` and ``b`` that both have them."""
    one = F.col("a.half").bitwiseXOR(F.col("b.half"))
    other = one.bitwiseXOR(F.col("a.bits")).bitwiseXOR(F.col("b.bits"))
    apart = F.bit_count(one) + F.bit_count(other)
    return F.coalesce(apart <= n + other_n - _needed(similarity, n, other_n) * 2, F.lit(True))


def _wide_may_match(similarity: int, a: str, b: str) -> Column:
    """The same by the wide bitmaps of the structs ``a`` and ``b``, if both have one."""
    n, other_n = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.wide")[k].bitwiseXOR(F.col(f"{b}.wide")[k])) for k in range(WIDE)), F.lit(0))
    return F.coalesce(apart <= n + other_n - _needed(similarity, n, other_n) * 2, F.lit(True))


def likely_pairs(classes: DataFrame, similarity: int) -> DataFrame:
    """``a, b``: for each class and key, the earliest class ``b`` with the same key, if another that may match."""
    keyed = classes.select(F.explode("keys").alias("key"), "doc_id", _place(classes).alias("place"), "sig", "n", "bits")
    # few keys are of more than one class; only their rows are carried further
    sides = keyed.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high"))
    shared = settle(sides.filter("low <> high").select("key"), "shared-keys")
    members = settle(keyed.join(small(shared), "key"), "key-members")
    if _whole_ids(classes):
        # all of one row, as they are led by the same number; numbers are grouped by hashing, structs by sorting
        first = F.struct(*[F.min_by(c, "place").alias(c) for c in ("sig", "n", "bits")])
    else:
        first = F.min(F.struct("doc_id", "sig", "n", "bits"))
    earliest = members.groupBy("key").agg(first.alias("b")).select("key", F.col("b.sig").alias("b"), F.col("b.n").alias("b_n"), F.col("b.bits").alias("b_bits"))
    near = _may_match(similarity, F.col("n"), F.col("bits"), F.col("b_n"), F.col("b_bits"))
    found = members.join(small(settle(earliest, "line-keys")), "key").filter((F.col("sig") != F.col("b")) & near)
    return found.select(F.col("sig").alias("a"), "b").distinct()


def repeated_classes(lines: DataFrame) -> DataFrame:
    """``sig, first, row, places`` of the classes with more than one line; ``row`` is one line's own, as rows repeated in id and text have the same place."""
    counted = lines.groupBy("sig").agg(F.min(F.struct(*_PLACE, "row")).alias("at"), F.count(F.lit(1)).alias("places"))
    first = F.struct(*[F.col(f"at.{c}").alias(c) for c in _PLACE]).alias("first")
    return settle(counted.filter("places > 1").select("sig", first, "at.row", "places"), "repeated")


def first_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """The first line of every class."""
    known = small(repeated.select("sig", F.col("row").alias("first_row")))
    return lines.join(known, "sig", "left").filter(F.col("first_row").isNull() | (F.col("row") == F.col("first_row"))).drop("first_row")


def _whole_ids(classes: DataFrame) -> bool:
    return isinstance(classes.schema["doc_id"].dataType, IntegralType)


def _place(classes: DataFrame) -> Column:
    """The document's place in the order; ids of another type do not sort as numbers: all places are then alike, and verification tells which line is earlier."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) if _whole_ids(classes) else F.lit(0).cast("long")


def _postings(classes: DataFrame, settled: DataFrame, words: Column) -> DataFrame:
    """A row for each class and each of ``words`` from the start of its prefix; ``settled`` as given by ``small``."""
    marked = classes.join(settled.withColumn("done", F.lit(True)), "sig", "left")
    # one number for the words, whether the class still searches and the place in the prefix
    size = F.when(F.col("done"), -F.col("n")).otherwise(F.col("n")).cast("long")
    rows = marked.select("sig", "bits", "half", _place(classes).alias("place"), size.alias("size"), F.posexplode(words).alias("pos", "word"))
    return rows.select("sig", "bits", "half", "place", (F.shiftleft("size", _POS_BITS) + F.col("pos")).alias("at"), "word")


def candidate_pairs(classes: DataFrame, settled: DataFrame, similarity: int, centers: DataFrame | None = None) -> DataFrame:
    """``a, b``: pairs of an unsettled class and another not later one that pass all filters.

    A pair that reaches the similarity always passes.  Of two classes that start in the
    same document both orders pass; verification tells which is later.  With ``centers``
    only those classes are searched for.

    All classes are joined with those that have no more words, by word and class of sizes.  These share at least as
    many words as two sets of their size must, so they are found by a shorter prefix,
    which leaves out its most frequent words.

    The words are joined in ``POSTING_ROUNDS`` parts, one after another, so that no more than a
    part of the postings lies on disk at a time.  Few centers are broadcast; then no
    posting goes to disk, and one part is enough.
    """
    known = small(settled)
    whole = F.col("prefix")
    postings = _postings(classes, known, whole)
    if centers is None:
        n = F.col("n")
        shorter = _postings(classes, known, F.slice(whole, F.lit(1), (n - _needed(similarity, n, n) + 1).cast("int")))
        return _pairs_in_parts(postings, shorter, similarity, POSTING_ROUNDS, _met_shorter)
    searched = settle(_postings(classes.join(small(centers), "sig", "left_semi"), known, whole), "centers")
    few = is_small(searched)
    return _pairs_in_parts(postings, F.broadcast(searched) if few else searched, similarity, 1 if few else POSTING_ROUNDS, _met)


def _pairs_in_parts(postings: DataFrame, searched: DataFrame, similarity: int, parts: int, met: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    if parts == 1:
        return met(postings, searched, similarity)
    found = None
    for turn in range(parts):
        of_turn = F.pmod(F.col("word"), F.lit(parts)) == turn
        part = settle(met(postings.filter(of_turn), searched.filter(of_turn), similarity), "pairs-of-turn")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _size(posting: str) -> Column:
    return F.shiftright(f"{posting}.at", _POS_BITS)


def _near(similarity: int) -> Column:
    """Whether postings ``a`` and ``b`` of the same word can be of similar sets."""
    a_pos, b_pos = (F.col(f"{x}.at").bitwiseAND((1 << _POS_BITS) - 1) for x in "ab")
    a_n, b_n = F.abs(_size("a")), F.abs(_size("b"))
    # the shared word and all that follow it must be enough
    placed = F.least(a_n - a_pos, b_n - b_pos) >= _needed(similarity, a_n, b_n)
    return _may_match(similarity, a_n, F.col("a.bits"), b_n, F.col("b.bits")) & placed & _halves_may_match(similarity, a_n, b_n)


def _met(postings: DataFrame, searched: DataFrame, similarity: int) -> DataFrame:
    """Unsettled classes of ``postings`` with the not later ones of ``searched``."""
    earlier = F.when(_size("a") > 0, F.col("a.place")) >= F.col("b.place")
    other = F.col("a.sig") != F.col("b.sig")
    met = postings.alias("a").join(searched.alias("b"), (F.col("a.word") == F.col("b.word")) & earlier & other & _near(similarity))
    return met.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b")).distinct()


def _size_class(similarity: int, n: Column) -> Column:
    """Rises with ``n``, by one at least in about the steps in which sets grow too large to be similar."""
    return F.floor(F.log(n) / math.log(_step(similarity))).cast("int")


def _step(similarity: int) -> float:
    return 100 / min(max(similarity, 1), 95)


def _by_size(postings: DataFrame, shorter: DataFrame, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Both with ``key``, for the word and a class of sizes; a row of ``shorter`` comes for each class in which a similar set of as many words or more can be.

    Two words that share a key make a pair more to look at; none is lost by that.
    """

    def key(size_class: Column) -> Column:
        return F.col("word").bitwiseXOR(F.shiftleft(size_class.cast("long"), _KEY_BITS - 9))

    n = F.abs(F.shiftright("at", _POS_BITS))
    larger = F.floor(n * 100 / max(similarity, 1))
    spread = shorter.select("*", F.explode(F.sequence(_size_class(similarity, n), _size_class(similarity, larger))).alias("size_class"))
    # the larger the others are, the more words they must share, and the earlier is the first of them
    least = F.greatest(n, F.floor(F.pow(F.lit(_step(similarity)), "size_class") * (1 - 1e-9)))
    spread = spread.filter(F.col("at").bitwiseAND((1 << _POS_BITS) - 1) <= n - _needed(similarity, n, least))
    return postings.withColumn("key", key(_size_class(similarity, n))).drop("word"), spread.withColumn("key", key(F.col("size_class"))).drop("word", "size_class")


def _met_shorter(postings: DataFrame, shorter: DataFrame, similarity: int) -> DataFrame:
    """The same for classes that all are in both: each pair is met once, with the class of more words from ``postings``."""
    postings, shorter = _by_size(postings, shorter, similarity)
    a_n, b_n = F.abs(_size("a")), F.abs(_size("b"))
    longer = (a_n > b_n) | ((a_n == b_n) & (F.col("a.sig") > F.col("b.sig")))
    a_asks = (_size("a") > 0) & (F.col("a.place") >= F.col("b.place"))
    b_asks = (_size("b") > 0) & (F.col("b.place") >= F.col("a.place"))
    met = postings.alias("a").join(shorter.alias("b"), (F.col("a.key") == F.col("b.key")) & longer & _near(similarity) & (a_asks | b_asks))

    def pair(asks: Column, a: str, b: str) -> Column:
        return F.when(asks, F.struct(F.col(f"{a}.sig").alias("a"), F.col(f"{b}.sig").alias("b")))

    return met.select(F.inline(F.array_compact(F.array(pair(a_asks, "a", "b"), pair(b_asks, "b", "a"))))).distinct()


def _sigs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()


def _words_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``sig, words``: the words of the lines at ``places``, a written table; only documents that have one are cut into lines."""
    def same(names: tuple[str, ...]) -> Column:
        pairs = [F.col(f"here.{c}").eqNullSafe(F.col(f"asked.{c}")) for c in names]
        return reduce(and_, pairs)

    asked_docs = settle(places.select("doc_id", "text_key").distinct(), "asked-documents")
    texts = docs.select(*_document_key(), "text").alias("here").join(small(asked_docs).alias("asked"), same(_PLACE[:2]), "left_semi")
    every = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = every.alias("here").join(small(places).alias("asked"), same(_PLACE))
    # rows repeated in id and text give the same words twice
    return found.select("asked.sig", F.array_distinct(_words(_folded(F.col("line")))).alias("words")).dropDuplicates(["sig"])


def with_earlier_match(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """``sig, center``: the classes ``a`` that reach the similarity with a ``b`` that starts earlier, verified on the words.

    A class starts at its first line in the order of (id, hash of the text, line number).
    """
    pairs = settle(pairs, "line-pairs")
    met = settle(_sigs(pairs), "met")
    places = settle(classes.join(small(met), "sig", "left_semi").select("sig", F.struct(F.struct(*_PLACE).alias("first"), "n", "wide").alias("at")), "places")
    both = pairs.join(places.withColumnsRenamed({"sig": "a", "at": "a_at"}), "a").join(places.withColumnsRenamed({"sig": "b", "at": "b_at"}), "b")
    ordered = both.filter((F.col("b_at.first") < F.col("a_at.first")) & _wide_may_match(similarity, "a_at", "b_at")).select("a", "b")
    ordered = settle(ordered, "ordered-pairs")
    wanted = settle(places.join(small(settle(_sigs(ordered), "wanted")), "sig", "left_semi").select("sig", "at.first.*"), "wanted-places")
    words = settle(_words_at(docs, wanted), "line-words")
    left, right = (words.select(F.col("sig").alias(x), F.col("words").alias(f"{x}_words")) for x in "ab")
    shared = F.size(F.array_intersect("a_words", "b_words"))

    def verified(some: DataFrame) -> DataFrame:
        both = some.join(left, "a").join(right, "b")
        alike = both.filter(shared * (100 + similarity) >= (F.size("a_words") + F.size("b_words")) * similarity)
        return alike.select(F.col("a").alias("sig"), F.col("b").alias("center"))

    # a pair carries the words of a line through an exchange, so many pairs go a part at a time
    parts = min(ROUNDS, max(1, math.ceil(ordered.count() / PAIRS_PER_ROUND)))
    if parts == 1:
        return settle(verified(ordered), "later")
    found = None
    for turn in range(parts):
        part = settle(verified(ordered.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == turn)), "later-of-turn")
        found = part if found is None else found.unionByName(part)
    return settle(found, "later")


def later_matches(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """``doc_id, text_key, removed`` (line numbers from 0): the lines that an earlier line matches."""
    return keep_last(docs.sparkSession, lambda: _later_matches(docs, similarity))


def _later_matches(docs: DataFrame, similarity: int) -> DataFrame:
    spark = docs.sparkSession

    def matched(pairs: Callable[[], DataFrame]) -> DataFrame:
        return keep_last(spark, lambda: with_earlier_match(pairs(), docs, classes, similarity))

    words = settle(line_words(docs).withColumn("row", F.monotonically_increasing_id()), "word-hashes")
    consumed = written_tables(spark)[-1:]
    # only classes are compared; of a line no more is kept than where it is and which class it has
    lines = settle(words.select(*_PLACE, "row", "sig"), "lines")
    repeated = repeated_classes(lines)
    classes = settle(with_keys(described(first_lines(words, repeated), _rarity(words), similarity)), "class-rows")
    release_tables(spark, consumed)
    likely = matched(lambda: likely_pairs(classes, similarity))
    settled = settle(likely.select("sig").distinct(), "settled")
    centers = settle(likely.groupBy(F.col("center").alias("sig")).count().filter(F.col("count") >= CENTER_FROM).select("sig"), "centers")
    if centers.count():
        # what the keys missed of a large group of near copies meets the group's first class here
        near = matched(lambda: candidate_pairs(classes, settled, similarity, centers))
        settled = settle(settled.union(near.select("sig")).distinct(), "settled")
    rest = matched(lambda: candidate_pairs(classes, settled, similarity))
    later = settled.union(rest.select("sig")).distinct().withColumn("later", F.lit(True))
    # a class goes whole if it has an earlier match, else but for its first line
    classes = settle(repeated.select("sig", "first").join(later, "sig", "full").select("sig", "first", F.coalesce("later", F.lit(False)).alias("later")), "classes")
    # joins two written tables: a line that holds a third of all rows is split
    gone = lines.join(classes, "sig").filter(F.col("later") | (F.struct(*_PLACE) != F.col("first")))
    return settle(gone.groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("removed")), "removed")


def dedup_lines(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """``docs`` without the lines that match an earlier line; adds ``n_lines`` and ``n_removed``.

    Lines are cut at line feeds.  Two match if the Jaccard similarity of their sets of
    lower-cased words is at least ``similarity`` percent.  Order is by ``doc_id`` (null
    first), then hash of the text, then line number; a line goes if any earlier line of
    the whole table matches it, whether that one stays or not.  Lines without words never
    match and stay; null texts stay null and have no lines, empty ones have one line
    without words; rows repeated in id and text count as one document and are cut
    alike; an empty table gives no rows; other columns are kept as they are, but for
    columns named ``n_lines`` and ``n_removed``, which are replaced.
    """
    gone = later_matches(docs, similarity).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("removed").alias("_removed"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*kept).alias("_row"), "text", *_document_key())
    joined = rows.join(small(gone, F.size("_removed")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    # a column of its own: inside the function below the text would be cut again for every line
    joined = joined.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    lines = F.col("_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    cut_text = F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(cut_text)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeats(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """``docs`` without repeated lines and without the documents of which no line with words is left, though there were some."""
    cut_docs = dedup_lines(docs, similarity)
    left = F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""
    return cut_docs.filter((F.col("n_removed") == 0) | left).select(*docs.columns)
