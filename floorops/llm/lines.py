"""Exact similarity join of lines, and removal of later matches; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorops.llm.common import materialize, partitions, without

#: Hash classes of words in the literal table that orders them by rarity.
CLASSES = 65536
#: A line's place is its document's id times this, plus its number.
PLACES = 10_000_000_000
#: Sets of up to this many words have one parity of 64 classes, larger ones two.
ONE_PARITY = 64
#: Candidates of more words than this have four.
TWO_PARITIES = 128
#: The two halves of a candidate's place are its quotient and remainder by this, so that pairs compare numbers and no decimals.
HALF = 10**17
#: Lines that share a key of the first comparison are compared in groups of about this size.
GROUP = 10_000
#: Lines tried from the front of such a group, and from just before a line.
TRIES = 3
#: The parities of lines, and those of candidates.
COARSE = ["b0", "b1"]
FINE = [*COARSE, "b2", "b3"]
#: What tells candidates apart: the line's hash and the halves of its place.
KEY = ["k1", "hi", "lo"]
_NO_ID = -10_000_000_000_000_000_000


def _tokens(line: Column) -> Column:
    """The words; sequences of white space and a line's ends may give empty ones."""
    other = line.rlike(r"[\t\x0B\f\r]")  # one search; four for single characters take longer than the split
    return F.split(F.when(other, F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line), " ")


def _at(id_col: str) -> Column:
    """Place of a line in the order of (id, line number), null ids first."""
    return (F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(_NO_ID)).cast("decimal(20,0)")) * F.lit(PLACES) + F.col("no")).cast("decimal(31,0)")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, no, k1, k2, line) of every line of the texts; ``k1`` and ``k2`` are the line's hashes, ``text_key`` the text's."""
    # outer: else Spark asks for the number of lines first, and splits the text twice; so for words and keys
    # a text and its hash are exploded as one row, as Spark puts off what stands beside a list until each of its lines, and hashes the text for each
    texts = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array(F.struct(F.xxhash64(text_col).alias("key"), F.split(text_col, "\n").alias("lines")))).alias("of"))
    some = texts.select("id", F.col("of.key").alias("text_key"), F.posexplode_outer("of.lines").alias("no", "line"))
    return some.filter("line IS NOT NULL").select("id", "text_key", "no", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), "line")


def _rarity(docs: DataFrame, text_col: str) -> Column:
    """For each hash class of words, how often they occur in the corpus, on a logarithmic scale from 1 to 127; a literal array."""
    words = docs.select(F.explode_outer(F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    count = dict(words.groupBy(F.xxhash64("w").bitwiseAND(CLASSES - 1).alias("c")).count().collect())
    scale = (min(127, 1 + int(4 * math.log2(1 + count.get(c, 0)))) for c in range(CLASSES))
    # without nulls, so that none is asked for at each word; only ANSI casts are sure to make none
    nulls = docs.sparkSession.conf.get("spark.sql.ansi.enabled") != "true"
    return F.split(F.lit(",".join(map(str, scale))), ",").cast(T.ArrayType(T.LongType(), nulls))


def _hashes(line: Column) -> Column:
    """Hashes of the line's different words."""
    return F.array_except(F.transform(_tokens(line), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))  # different ones, in one pass


def _ordered(hashes: Column, rarity: Column) -> Column:
    """The words as numbers, rare ones first: how often their class occurs, then the hash. ``rarity`` has a power of two of classes."""
    last = (F.size(rarity) - 1).cast("bigint")
    often = lambda x: F.coalesce(rarity[x.bitwiseAND(last)], F.lit(1).cast("bigint"))  # noqa: E731  never null, so that numbers are sorted and no objects
    return F.sort_array(F.transform(hashes, lambda x: F.shiftleft(often(x), 56).bitwiseOR(F.shiftrightunsigned(x, 8))))


def _parity(words: Column, *bits: int) -> Column:
    """64 bits of a set: each of its words, or each whose number has all of ``bits`` set, turns the bit of its hash over.

    A shift takes the last six bits of the hash, so that nothing has to be cut or cast for each word.
    """
    one = F.lit(1).cast("bigint")

    def turn(parity: Column, x: Column) -> Column:
        own = one
        for b in bits:
            own = own.bitwiseAND(F.shiftright(x, b))
        return parity.bitwiseXOR(F.call_function("shiftleft", own, F.hash(x)))

    return F.aggregate(words, F.lit(0).cast("bigint"), turn)


def _parities(words: Column, n: Column, fine: bool) -> list[Column]:
    """Up to 256 bits of a set of ``n`` words, as COARSE or FINE numbers; small sets are told apart by 64, and get 0 for the others."""
    none = F.lit(0).cast("bigint")
    rest = [(ONE_PARITY, (6,)), (TWO_PARITIES, (7,)), (TWO_PARITIES, (6, 7))][: 3 if fine else 1]
    return [_parity(words), *[F.when(n > most, _parity(words, *bits)).otherwise(none) for most, bits in rest]]


def profiles(lines: DataFrame, rarity: Column, threshold: float, min_words: int, fine: bool = False) -> DataFrame:
    """``lines`` (with k1, line), with what the filters need in place of the line.

    ``n`` words, parities ``b0`` and ``b1`` of the set, and ``keys``: the prefix
    of the rarest words, of which two matching sets share one. Sets so small
    that only equal ones match have one key, the hash of the set; those of
    fewer than ``min_words`` words have none. ``fine`` adds parities ``b2`` and
    ``b3``, the words as numbers, and the least and the greatest of their
    hashes.
    """
    t = threshold
    kept = [c for c in lines.columns if c != "line"]
    # the hashes are used twice, so Spark keeps them as a step of its own and compiles what makes them different
    hashed = lines.select(*kept, _hashes(F.col("line")).alias("h"))
    sets = hashed.select(*kept, F.size("h").alias("n"), _ordered(F.col("h"), rarity).alias("w"))
    n = F.col("n")
    prefix = F.slice("w", F.lit(1), (n - F.ceil(n * F.lit(t) - 1e-9) + 1).cast("int"))
    whole = F.array(F.xxhash64("w"))
    keys = F.when(n < max(1, min_words), F.slice("w", 1, 0)).when(n < t / (1 - t) - 1e-9 if t < 1 else F.lit(True), whole).otherwise(prefix)
    more = [c.alias(b) for b, c in zip(FINE if fine else COARSE, _parities(F.col("w"), n, fine), strict=True)]
    if fine:
        hashes = F.transform("w", lambda x: x.bitwiseAND((1 << 56) - 1))
        more += [F.array_min(hashes).alias("low"), F.array_max(hashes).alias("high"), F.col("w")]
    return sets.select(*kept, "n", keys.alias("keys"), *more)


def postings(lines: DataFrame, *kept: str) -> DataFrame:
    """(word, kept..., np) for each key of the profiles; ``np`` holds the set's size, whether it has copies, and the key's position."""
    size = (F.col("n").cast("bigint") * 2 + F.col("copied").cast("bigint")) * 65536
    rows = lines.select(*kept, size.alias("size"), F.posexplode_outer("keys").alias("p", "word")).filter("p IS NOT NULL")
    return rows.select("word", *kept, (F.col("size") + F.least("p", F.lit(65535))).alias("np"))


def _fits(t: float, a: str, b: str, fine: bool = False) -> Column:
    """Whether the length, positional and parity filters pass rows of the columns whose names begin like this.

    The positional filter takes the shared word for the first one, as which it
    must pass if the sets match: so a pair that shares many is not found for
    each of them. What passes it also passes the length filter, as the smaller
    set alone must make up the overlap. All sums are of doubles, as those of
    integers are checked for overflow, which takes longer than the filters.
    The overlap needs no rounding up, as two sets and their parities differ in
    an even number both, or in an odd one.
    """
    na, nb = (F.shiftright(F.col(f"{x}np"), 17).cast("double") for x in (a, b))
    pa, pb = (F.col(f"{x}np").bitwiseAND(65535).cast("double") for x in (a, b))
    need = (na + nb) * F.lit(t / (1 + t)) - 1e-9
    x = [F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")) for c in (FINE if fine else COARSE)]
    bits = lambda c: F.bit_count(c).cast("double")
    differ = F.when((na > ONE_PARITY) & (nb > ONE_PARITY), bits(x[0].bitwiseXOR(x[1])) + bits(x[1])).otherwise(bits(x[0]))
    if fine:
        both = x[0].bitwiseXOR(x[1]).bitwiseXOR(x[2]).bitwiseXOR(x[3])
        four = bits(both) + bits(x[1].bitwiseXOR(x[3])) + bits(x[2].bitwiseXOR(x[3])) + bits(x[3])
        differ = F.when((na > TWO_PARITIES) & (nb > TWO_PARITIES), four).otherwise(differ)
    return (na - pa >= need) & (nb - pb >= need) & (differ <= na + nb - need * F.lit(2.0))


def _earlier() -> Column:
    """Whether the other line's place comes first."""
    return (F.col("o_hi") < F.col("hi")) | ((F.col("o_hi") == F.col("hi")) & (F.col("o_lo") < F.col("lo")))


def _others(cols: list[str]) -> list[str]:
    return [f"o_{c}" for c in cols]


def _other(df: DataFrame, *same: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in same else f"o_{c}") for c in df.columns])


def candidates(docs: DataFrame, rarity: Column, threshold: float, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(k1): the hashes of lines that may have a match: those with a copy, and those that pass the filters with another line.

    Equal lines (by 96 bits of hash) are one from the start, in every task
    before the shuffle. The join only asks whether there is a partner, so that
    it ends at the first one and a large group of near copies makes no pairs.
    Both its sides are one shuffle.
    """
    profiled = profiles(lines_of(docs, id_col, text_col).select("k1", "k2", "line"), rarity, threshold, min_words)
    first = [F.first(c).alias(c) for c in ("n", *COARSE, "keys")]
    one = postings(profiled.groupBy("k1", "k2").agg(*first, (F.count("*") > 1).alias("copied")), "k1", *COARSE)
    # both sides by one name and not renamed: so Spark sees that they are one shuffle
    partner = (F.col("b.k1") != F.col("a.k1")) & _fits(threshold, "a.", "b.")
    copied = F.shiftright("a.np", 16).bitwiseAND(1) == 1
    found = one.alias("a").join(one.alias("b"), (F.col("a.word") == F.col("b.word")) & (copied | partner), "left_semi")
    return found.select("k1").distinct()


def first_tries(lines: DataFrame, threshold: float) -> DataFrame:
    """(KEY, and the other line's with o_): a few earlier lines that each line may match, of those that share its least or greatest word hash.

    Lines of a key are compared in groups of about ``GROUP``, with the first
    lines of the group and those just before. Near copies share a key as often
    as words, so that members of a large group are settled here, without pairs.
    """
    line = [*KEY, "np", *FINE]
    keyed = lines.withColumn("np", F.col("n").cast("bigint") * 131072).select(*line, F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("of")).filter("of > 1")
    salted = keyed.join(often, "key").withColumn("salt", F.pmod(F.xxhash64("k1"), F.ceil(F.col("of") / GROUP)))
    dealt = salted.repartition(partitions(lines.sparkSession), "key", "salt")
    by_key = W.partitionBy("key", "salt").orderBy("hi", "lo", "k1")
    before = by_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    one = F.struct(*line)
    tried = [F.nth_value(one, i).over(before) for i in range(1, TRIES + 1)] + [F.lag(one, i).over(by_key) for i in range(1, TRIES + 1)]
    rows = dealt.select(*line, F.array(*tried).alias("tried")).select(*line, F.explode(F.array_distinct("tried")).alias("o"))
    rows = rows.filter("o IS NOT NULL").select(*line, *[F.col(f"o.{c}").alias(f"o_{c}") for c in line])
    return rows.filter(_earlier() & _fits(threshold, "", "o_", fine=True)).select(*KEY, *_others(KEY)).distinct()


def matches(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(KEY): the lines of ``pairs`` (as of ``first_tries``) whose words (by more than 56 bits of hash) match the other line's."""
    words = lines.select(*KEY, "w")
    both = pairs.join(words, KEY).join(_other(words), _others(KEY))
    # shared >= t (sizes - shared), with the words compared once
    same = F.size(F.array_intersect("w", "o_w")) * F.lit(1 + threshold) >= F.lit(threshold) * (F.size("w") + F.size("o_w")) - 1e-9
    return both.filter(same).select(*KEY).distinct()


def removed_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, no) of each line that has an earlier match.

    Lines match if the Jaccard similarity of their word sets is at least
    ``threshold``; lines of fewer than ``min_words`` different words are left
    alone, blank ones always. Earlier is a smaller (id, line number), null ids
    first.

    Words are ordered by rarity, for which the counts of ``CLASSES`` hash
    classes and then the length are enough: the order decides how many
    candidates there are, not which matches are found. Two sets can only match
    if their prefixes (the first n - ceil(t n) + 1 words) share a word. Of the
    pairs that do, those whose sizes differ too much fall to the length filter,
    and those whose words from the shared one on cannot make up the overlap to
    the positional filter, which are one test. Those left are compared by the
    parities of 64 or 128 (candidates: up to 256) hash classes of their words,
    which differ in no more classes than the sets do in words.

    First, lines that pass these filters with no other line are set aside, by
    hashes alone (``candidates``). The texts of the others are fetched; equal
    texts are one from here on. A line needs only one earlier match, so each is
    first compared with a few likely ones (``first_tries``); the lines that
    remain are joined with all earlier ones. Words themselves decide in both.
    """
    t = threshold
    rarity = _rarity(docs, text_col)
    some = materialize(candidates(docs, rarity, t, min_words, id_col, text_col), "line-candidates")
    lines = lines_of(docs, id_col, text_col).drop("k2").join(some.hint("shuffle_hash"), "k1", "left_semi").withColumn("at", _at("id"))
    lines = materialize(lines, "lines")
    first = lines.groupBy("k1", "line").agg(F.min("at").alias("at"), F.lit(False).alias("copied"))
    low = F.pmod("at", F.lit(str(HALF)).cast("decimal(18,0)"))
    first = first.withColumns({"hi": F.call_function("div", F.col("at") - low, F.lit(HALF)), "lo": low.cast("bigint")})
    texts = materialize(profiles(first, rarity, t, min_words, fine=True), "line-texts")

    tried = materialize(first_tries(texts, t), "line-tries")
    settled = materialize(matches(tried, texts, t), "line-settled")

    short = texts.drop("w", "low", "high", "at")
    cols = (*KEY, *FINE)
    left = postings(short.join(settled, KEY, "left_anti"), *cols)
    pairs = left.join(_other(postings(short, *cols), "word"), "word").filter(_earlier() & _fits(t, "", "o_", fine=True))
    pairs = pairs.select(*KEY, *_others(KEY)).distinct().join(tried, [*KEY, *_others(KEY)], "left_anti")
    found = matches(materialize(pairs, "line-pairs"), texts, t)
    kept = materialize(texts.select(*KEY, "at").join(settled.union(found), KEY, "left_anti").select("k1", "at"), "line-kept")
    return lines.join(kept.hint("shuffle_hash"), ["k1", "at"], "left_anti").select("id", "text_key", "no")


def dedup_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later matching lines removed from the text; adds ``n_lines`` and ``removed`` (their numbers, sorted).

    See ``removed_lines`` for what matches; all lines are judged on the input.

    Defined cases: a null text stays null and has 0 lines; an empty text has
    one line, which stays, as do blank lines and all lines of fewer than
    ``min_words`` different words; null ids sort first and are one document for
    the order; rows that share an id are judged line by line in the order of
    (id, line number), lines at the same place not matching each other; rows
    that share id and text get the same result; an empty table gives an empty
    result; input columns called like the new ones are replaced, all others are
    kept. Ids are integers. Lines with one 64-bit hash are told apart by their
    texts, once one of them is a candidate.
    """
    docs = without(docs, "n_lines", "removed")
    gone = removed_lines(docs, threshold, min_words, id_col, text_col)
    gone = gone.groupBy("id", "text_key").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    row = docs.select(F.struct("*").alias("row")).withColumn("text_key", F.xxhash64(F.col("row")[text_col]))
    same = F.col("row")[id_col].eqNullSafe(F.col("g.id")) & (F.col("r.text_key") == F.col("g.text_key"))
    joined = row.alias("r").join(gone.hint("shuffle_hash").alias("g"), same, "left").select("row", "gone")
    text = F.col("row")[text_col]
    split = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    whole = joined.select("row", "gone", split.alias("split"), F.when(F.col("gone").isNotNull(), places).alias("places"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform("places", lambda i: F.get(F.col("split"), i)), "\n"))
    cols = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size("split")).cast("long")
    return whole.select(*cols, n_lines.alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"))
