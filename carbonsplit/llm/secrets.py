"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean trigram query: the literal runs
every match must contain.  The index lists, for each trigram that some query asks for,
the texts that contain it; a rule's candidates are the intersection of its trigrams'
postings, and only they are searched with the expression.  A rule without mandatory
trigrams is searched in every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as _op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut

#: A query is a set of alternatives; each is the set of trigrams it needs.  Beyond this many, the weakest form is used.
MAX_ALTERNATIVES = 64
#: Marks put around matches; the same characters in a text become a third first, which no rule matches.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost first and not overlapping; those that do not fit ``fits`` are dropped.

    ``fits`` is searched in the matched text.  Both are written for Java and must not
    match the characters U+0001 to U+0003.
    """

    kind: str
    pattern: str
    fits: str = ""


#: Fixed patterns of the three base kinds, in the order in which they are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{16,}$"),
    # runs are maximal, so asking for the length at once finds the same
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Fixed patterns of public token formats that the method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives of mandatory lower-case trigrams, or None if a match may have none.

    The expression is read as a sequence of pieces.  Pieces with few possible strings
    (literals, optional or alternative literals, small classes) are multiplied out into
    runs; every other piece ends the run.  A piece that may be left out adds no demand.
    """
    runs = _runs(list(_parser.parse(pattern.replace("(?i:", "(?:"))))
    alternatives = set()
    for run in runs:
        grams = frozenset(part[i : i + 3] for part in run for i in range(len(part) - 2))
        if not grams:
            return None
        alternatives.add(grams)
    # an alternative that asks for more than another one adds nothing
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _runs(pieces: list) -> list[tuple[str, ...]]:
    """All ways to match, each as its literal runs in order; '' between runs stands for anything."""
    ways: list[tuple[str, ...]] = [("",)]
    for piece in pieces:
        choices = _choices(piece)
        combined = {_glued(a, b) for a, b in itertools.product(ways, choices)}
        # too many: forget what this piece says, which only weakens the query
        ways = sorted(combined) if len(combined) <= MAX_ALTERNATIVES else [(*way, "") for way in ways]
    return ways


def _glued(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return (*a[:-1], a[-1] + b[0], *b[1:])


_ANY = [("", "")]


def _choices(piece: tuple) -> list[tuple[str, ...]]:
    kind, value = piece
    if kind is _op.LITERAL:
        return [(chr(value).lower(),)]
    if kind is _op.AT:
        return [("",)]
    if kind is _op.SUBPATTERN:
        return _runs(list(value[-1]))
    if kind is _op.BRANCH:
        return [way for branch in value[1] for way in _runs(list(branch))]
    if kind is _op.IN and len(value) <= 5 and all(k is _op.LITERAL for k, _ in value):
        return sorted({(chr(v).lower(),) for _, v in value})
    if kind in (_op.MAX_REPEAT, _op.MIN_REPEAT):
        least, most, inner = value
        if (least, most) == (0, 1):
            return [("",), *_runs(list(inner))]
        if least and (once := _runs(list(inner))) != _ANY:
            return [_glued(way, ("", "")) for way in once]
    return _ANY


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, wanted``: for each text that some rule's index query admits, the rules' numbers.

    ``texts`` has ``key`` (a hash of the text) and ``text``.  The postings have a row for
    each text and each trigram that a query asks for.  A rule's alternative is met by the
    texts found in the postings of all its trigrams: their number is counted, which
    Spark does per input partition first.
    """
    asked = [(n, alternative) for n, rule in enumerate(rules) if (query := trigram_query(rule.pattern)) for alternative in sorted(query, key=sorted)]
    if not asked:
        return texts.select("key", F.array().cast("array<int>").alias("wanted")).limit(0)
    grams = sorted({gram for _, alternative in asked for gram in alternative})
    # a column of its own, so that a text is folded once and not once per trigram
    lowered = texts.select("key", F.lower("text").alias("lowered"))
    present = F.array(*[F.when(F.col("lowered").contains(gram), F.lit(gram)) for gram in grams])
    postings = lowered.select("key", F.explode(F.array_compact(present)).alias("gram")).distinct()
    # the trigrams of the rules: a few dozen, whatever the input
    needs = texts.sparkSession.createDataFrame(
        [(n, place, gram, len(alternative)) for place, (n, alternative) in enumerate(asked) for gram in sorted(alternative)],
        "rule int, place int, gram string, needed long",
    )
    met = postings.join(F.broadcast(needs), "gram").groupBy("key", "place", "rule", "needed").count().filter("count = needed")
    return met.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("wanted"))


def _matches(text: Column, rule: Rule) -> Column:
    """``array<struct<start, kind, end>>`` of one rule, by code points, end exclusive.

    The expression puts marks around its matches; cutting at the opening marks and adding
    up lengths gives the places.  The lengths are added along the parts of this text only.
    """
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))
    parts = F.split(marked, _OPEN)
    head = F.length(F.element_at(parts, 1)).cast("long")
    empty = F.array().cast("array<struct<start: long, n: long, ok: boolean>>")

    def placed(state: Column, part: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        fits = match.rlike(rule.fits) if rule.fits else F.lit(True)
        found = F.struct(state["at"].alias("start"), F.length(match).cast("long").alias("n"), fits.alias("ok"))
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), F.array_append(state["found"], found).alias("found"))

    start = F.struct(head.alias("at"), empty.alias("found"))
    found = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, placed, lambda state: state["found"])
    return F.transform(F.filter(found, lambda m: m["ok"]), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["n"]).alias("end")))


def _named(matches: Column, number: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), F.lit(kind).alias("name"), m["end"].alias("end")))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``, an array of ``struct<start, kind, name, end>``, one row per document.

    Spans are code point offsets in the whole text, end exclusive, sorted by start and
    then by the order of ``rules`` (``kind`` is its number).  Matches of one rule do not
    overlap; those of different rules may.  Null texts count as empty; empty texts have
    no spans; repeated rows get the same spans; empty tables give no rows; columns other
    than ``keep`` and ``text`` do not matter.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(text)
    # texts with equal hashes share candidates, which only adds texts to search
    wanted = cut(candidates(docs.select(key.alias("key"), text.alias("text")), rules), "candidates")
    rows = docs.select(F.struct(*keep).alias("_keep"), F.translate(text, _OPEN + _CLOSE, _OTHER * 2).alias("_text"), key.alias("_key"))
    joined = rows.join(wanted.withColumnRenamed("key", "_key"), "_key", "left")
    none = F.array().cast("array<struct<start: long, kind: int, name: string, end: long>>")
    found = []
    for n, rule in enumerate(rules):
        search = F.col("_text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            search = F.coalesce(F.array_contains("wanted", n), F.lit(False)) & search
        found.append(F.when(search, _named(_matches(F.col("_text"), rule), n, rule.kind)).otherwise(none))
    return joined.select("_keep", F.sort_array(F.concat(*found)).alias("spans")).select("_keep.*", "spans")
