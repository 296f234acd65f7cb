"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines within ``threshold`` edits, the shorter cut into threshold + 1
segments, share one segment unchanged, at a place in the longer one that the
lengths bound closely. Every distinct line gives the hashes of its own segments
and of those substrings that could be a segment of a line up to ``threshold``
characters shorter, each with that line's length and the segment's number.
Lines that share a hash are candidates, all with the earliest one first, then
the open ones with all earlier ones of their hash. Where a hash has too many
lines for that, they meet again by finer keys: what is left of two near lines
without the shared segment is within the threshold too, so it is cut into
segments in turn, and so on until little is left; lines that are equal but for
a few characters meet by those characters without as many as the threshold.
Candidates are verified by a banded bit-parallel automaton: one bit for each
diagonal within the threshold and each number of edits, one step for each
character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.names import fresh
from ruleloom.plans.durable import materialize, settled

#: Shorter lines (headings, closings) go for equal ones alone: one edit in a few characters makes another word.
MIN_CHARS = 20
#: What makes a line other than blank.
FILLED = r"[^\x20\x09-\x0D]"
THRESHOLD = 2
#: Lines of a hash that are all compared with each other at most, more meet by finer keys; open lines that one task compares with the earlier ones; characters that are not cut further.
SMALL, PART, SHORT = 2_000, 128, 12
#: Lines whose places are sent to every executor at most; more are joined by a shuffle.
SEND_IDS = 1_000_000
#: Keys whose figures are sent to every executor at most.
SEND_KEYS = 100_000


def _segments(line: Column, threshold: int) -> list[tuple[Column, Column, Column, int, bool]]:
    """(start, width, length, number, own) of the line's own segments and of the substrings that could be segments of another line of that length."""
    n, out = F.length(line), []
    for shorter in range(threshold + 1):
        size = n - shorter
        base = F.floor(size / (threshold + 1)).cast("int")
        long_ones = size % (threshold + 1)  # the last segments are one longer
        for i in range(threshold + 1):
            extra = F.greatest(F.lit(0), F.lit(i) - (threshold + 1) + long_ones)  # longer segments before this one
            start = base * i + extra + 1
            width = base + (F.lit(i) >= (threshold + 1) - long_ones).cast("int")
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            out += [(start + move, width, size, i, shorter == move == 0) for move in range(low, high + 1)]
    return out


def segment_keys(line: Column, threshold: int) -> Column:
    """Hashes of the substrings that are, or could be, segments; those of its own segments are among them."""
    return F.array_distinct(F.array(*(F.xxhash64(F.substring(line, start, width), size, F.lit(i)) for start, width, size, i, _ in _segments(line, threshold))))


def rest_keys(rest: Column, threshold: int, *under: Column) -> Column:
    """(key, rest, own): as :func:`segment_keys`, with what is left without the substring and whether it is the line's own segment; ``under``: what goes into the hash too."""
    rows = []
    for start, width, size, i, own in _segments(rest, threshold):
        key = F.xxhash64(*under, F.substring(rest, start, width), size, F.lit(i))
        rows.append(F.struct(key.alias("key"), F.concat(F.substring(rest, F.lit(1), start - 1), F.substring(rest, start + width, F.length(rest))).alias("rest"), F.lit(own).alias("own")))
    return F.array_distinct(F.array(*rows))


def shorter_ones(rest: Column, threshold: int) -> Column:
    """The strings that ``rest`` leaves without up to ``threshold`` characters; strings within the threshold have one in common."""
    out = F.array(rest)
    for _ in range(threshold):
        less = F.flatten(F.transform(out, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))))
        out = F.array_distinct(F.concat(out, less))
    return out


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _common(v: Column) -> Column:
    """The length of the common prefix of v.a and v.b, by halving: comparisons of whole substrings, not of characters."""
    bits = F.when(v["n"] > 0, F.sequence(F.floor(F.log2(v["n"])).cast("int"), F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.lit(0)

    def step(m: Column, k: Column) -> Column:
        upto = m + F.call_function("shiftleft", F.lit(1), k)
        return F.when((upto <= v["n"]) & (F.substring(v["a"], start + 1, upto) == F.substring(v["b"], start + 1, upto)), upto).otherwise(m)

    return F.aggregate(bits, start, step)


def _rest(a: Column, b: Column) -> Column:
    """struct(a, b, n) without their common prefix, the other way round, and the shorter one's length."""
    ends = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))
    cut = lambda x, p: F.reverse(F.substring(x, p + 1, F.length(x)))
    return _let(ends(a, b), lambda v: _let(_common(v), lambda p: ends(cut(v["a"], p), cut(v["b"], p))))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most ``threshold`` (0 to 4).

    What they share at their start and end changes no distance and is cut off
    first; the automaton reads what is left.
    """
    core = _let(_rest(a, b), lambda r: _rest(r["a"], r["b"]))
    return (F.abs(F.length(a) - F.length(b)) <= threshold) & _let(core, lambda c: automaton(c["a"], c["b"], threshold))


def automaton(a: Column, b: Column, threshold: int) -> Column:
    """As :func:`within`, by one banded bit-parallel automaton over whole strings.

    Bit d + threshold of level e says that the first j + d characters of ``a``
    turn into the first j of ``b`` with e edits; the levels share one long.
    """
    t, w = threshold, 2 * threshold + 1
    if not 0 <= t <= 4:
        raise ValueError("threshold must be 0 to 4")
    full = (1 << w) - 1
    chars_a, chars_b, nb = F.split(a, ""), F.split(b, ""), F.length(b)
    zipped = [chars_b.alias("b")]
    for d in range(-t, t + 1):
        moved = F.concat(F.array_repeat(F.lit(None).cast("string"), -d), chars_a) if d < 0 else F.slice(chars_a, d + 1, F.greatest(F.length(a), F.lit(1)))
        zipped.append(moved.alias(f"a{d + t}"))
    steps = F.slice(F.arrays_zip(*zipped), 1, nb)
    start = sum(sum(1 << (d + t) for d in range(e + 1)) << (e * w) for e in range(t + 1))

    def step(state: Column, x: Column) -> Column:
        mask = F.lit(0).cast("long")
        for d in range(w):
            mask = mask.bitwiseOR(F.when(x["b"] == x[f"a{d}"], F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
        old = [F.shiftright(state, e * w).bitwiseAND(F.lit(full)) for e in range(t + 1)]
        new = [old[0].bitwiseAND(mask)]
        for e in range(1, t + 1):
            new.append(old[e].bitwiseAND(mask).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(F.lit(full)))
        out = new[0]
        for e in range(1, t + 1):
            out = out.bitwiseOR(F.shiftleft(new[e], e * w))
        return out

    end = F.aggregate(steps, F.lit(start).cast("long"), step)
    gap = F.length(a) - nb
    return (F.abs(gap) <= t) & (F.call_function("shiftrightunsigned", end, F.greatest(F.lit(0), gap + t) + t * w).bitwiseAND(F.lit(1)) == 1)


def letter_parity(line: Column) -> Column:
    """A bit for each of 64 classes of letters: whether the line has an odd number of them. One edit changes two bits at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)))))


def _close(a: Column, b: Column, pa: Column, pb: Column, threshold: int) -> Column:
    """``within``, after the letters' parities, which leave most pairs out and none that are near."""
    return F.when(F.bit_count(pa.bitwiseXOR(pb)) <= 2 * threshold, within(a, b, threshold)).otherwise(F.lit(False))


def _lines(docs: DataFrame, min_chars: int, every_length: bool) -> DataFrame:
    lines = docs.where("doc is not null and text is not null").select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    long_ones = F.length("line") >= min_chars
    lines = lines.where(long_ones | F.col("line").rlike(FILLED) if every_length else long_ones)
    return lines.select("doc", "version", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, parity) of the given (id, doc, version, pos)."""
    wanted = materialize(ids.groupBy("doc", "version").agg(F.collect_list(F.struct("pos", "id")).alias("at")), "op6-wanted")  # at most a document's lines
    lines = wanted.agg(F.sum(F.size("at"))).first()[0] or 0
    wanted = F.broadcast(wanted) if lines <= SEND_IDS else wanted
    some = docs.join(wanted, ["doc", "version"]).dropDuplicates(["doc", "version"]).withColumn("_lines", F.split("text", "\n", -1))
    some = some.select(F.explode(F.transform("at", lambda x: F.struct(x["id"].alias("id"), F.get("_lines", x["pos"]).alias("line")))).alias("x")).select("x.*")
    return some.withColumn("parity", letter_parity(F.col("line")))


def _led(keyed: DataFrame, settle: bool = True) -> DataFrame:
    """The rows of keys that several lines share, with the earliest of them as ``lead``; where ``own`` says so, one of them has the key by its own segment."""
    keyed = materialize(keyed, "op6-keys") if settle else keyed
    own = F.max("own") if "own" in keyed.columns else F.lit(True)
    groups = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"), own.alias("own")).where("lead < last and own").select("key", "lead")
    return materialize(keyed.join(groups, "key"), "op6-members")


def _near_lead(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(id) of the lines within the threshold of an earliest one."""
    star = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("parity").alias("pa")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("parity").alias("pb")), "b")
    return materialize(star.where(_close(F.col("la"), F.col("lb"), F.col("pa"), F.col("pb"), threshold)).select(F.col("b").alias("id")).distinct(), "op6-near")


def _pairs(members: DataFrame, near: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(id) of open members that are near an earlier one of their key; a key's open lines are dealt into parts of about PART, the earlier ones go to each."""
    later = members.where("id <> lead").join(near, "id", "left_anti").join(texts, "id")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    later = later.select(F.col("key").alias("k"), part.alias("p"), F.col("id").alias("b"), "lead", F.col("line").alias("lb"), F.col("parity").alias("pb"))
    earlier = members.join(texts, "id").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("line").alias("la"), F.col("parity").alias("pa"))
    close = _close(F.col("la"), F.col("lb"), F.col("pa"), F.col("pb"), threshold)
    pairs = earlier.join(later, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")) & F.expr("a < b and a <> lead") & close)
    return pairs.select(F.col("b").alias("id")).distinct()


def _more(near: DataFrame, found: DataFrame) -> DataFrame:
    return materialize(near.union(found).distinct(), "op6-near")


def _by_key(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found for their key, which is sent to them where the keys are few."""
    found = materialize(found, "op6-by-key")
    return rows.join(F.broadcast(found) if found.count() <= SEND_KEYS else found, "key")


def _stripped(rows: DataFrame) -> DataFrame:
    """(key, id, rest, longest): the rests without what all of a key have in common at their start and end, which changes no distance."""
    for _ in range(2):  # the start, then, turned round, the end
        ends = F.struct(F.min("rest").alias("a"), F.max("rest").alias("b"), F.least(F.length(F.min("rest")), F.length(F.max("rest"))).alias("n"))
        same = rows.groupBy("key").agg(ends.alias("v")).select("key", _common(F.col("v")).alias("same"))
        # the least and the greatest have in common what all have
        rows = _by_key(rows, same).select("key", "id", F.reverse(F.substring("rest", F.col("same") + 1, F.length("rest"))).alias("rest"))
    return _by_key(rows, rows.groupBy("key").agg(F.max(F.length("rest")).alias("longest")))


def _settled(members: DataFrame, near: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(id) of all lines near an earlier one: ``near``, and what the keys' other members add.

    ``members``: (key, id, lead) of lines that share a key with others; in later
    rounds (key, id, rest, lead), where the lines of a key differ in their rests alone.
    """
    while True:
        open_ = members.where("id <> lead").join(near, "id", "left_anti").groupBy("key").agg(F.lit(1).alias("one")).select("key")
        sizes = members.join(open_, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
        some = materialize(members.join(sizes, "key"), "op6-open")
        small = some.where(F.col("n") <= SMALL).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
        near = _more(near, _pairs(small, near, texts, threshold))
        big = some.where(F.col("n") > SMALL)
        if big.isEmpty():
            return near
        if "rest" not in members.columns:  # the first round: what the shared segment leaves of each line
            cut = big.select("key", "id").join(texts, "id").select("key", "id", F.explode(rest_keys(F.col("line"), threshold)).alias("x")).where("x.key = key")
            cut = materialize(cut.select("key", "id", "x.rest", "x.own"), "op6-rests")
            big = _by_key(cut, cut.where("own").select("key").distinct())
        big = materialize(_stripped(big), "op6-rests")
        ends = big.where(F.col("longest") <= SHORT)
        if not ends.isEmpty():
            keyed = ends.select("id", F.explode(F.transform(shorter_ones(F.col("rest"), threshold), lambda s: F.xxhash64(F.lit(2), F.col("key"), s))).alias("key")).distinct()
            ends = _led(keyed.select("key", "id"))
            near = _more(near, _near_lead(ends, texts, threshold))
            counts = ends.join(ends.where("id <> lead").join(near, "id", "left_anti").select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
            near = _more(near, _pairs(ends.join(counts, "key"), near, texts, threshold))
        finer = big.where(F.col("longest") > SHORT)
        if finer.isEmpty():
            return near
        finer = finer.select("id", F.explode(rest_keys(F.col("rest"), threshold, F.col("key"))).alias("x")).select("x.key", "id", "x.rest", "x.own").distinct()
        members = _led(finer)
        near = _more(near, _near_lead(members, texts, threshold))


def versions(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells documents of one id apart: the text's hash, or 0 where every id has one text."""
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("h")).where("doc is not null")
    several = texts.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    return F.lit(0).cast("long") if several.isEmpty() else F.xxhash64(text_col)


def duplicate_lines(docs: DataFrame, id_col: str, text_col: str, version: Column, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, every_length: bool = False) -> DataFrame:
    """(doc, version, at): the line numbers, from 0, that go from each document that loses any.

    A line goes if an earlier one, in the order of ids, versions and line
    numbers, is equal or within ``threshold`` edits; see :func:`line_dedup` for
    its length. ``version`` tells documents of one id apart; see :func:`versions`.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), version.alias("version"))
    lines = _lines(docs, min_chars, every_length)
    # none for lines that go for equal ones alone; a slice, as in a branch Spark computes each shared part again
    keys = F.slice(segment_keys(F.col("line"), threshold), F.lit(1), F.when(F.length("line") >= min_chars, F.lit(1 << 16)).otherwise(F.lit(0)))
    made = lines.groupBy("h", "g").agg(F.min(F.struct("doc", "version", "pos", keys.alias("keys"))).alias("x"))
    made = materialize(made.select("h", "g", "x.*"), "op6-lines")

    # an id that sorts as (doc, version, pos): packed into a long where the values allow it
    span = made.agg(F.max("pos"), F.min("doc"), F.max("doc"), F.max(F.col("version") != 0)).first()
    integral = made.schema["doc"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    bits = int(span[0] or 0).bit_length()
    if integral and span[1] is not None and not span[3] and (int(span[2]) - int(span[1])).bit_length() + bits <= 62:
        ident = F.shiftleft(F.col("doc").cast("long") - F.lit(int(span[1])), bits) + F.col("pos")
    else:
        ident = F.struct("doc", "version", "pos")
    made = made.withColumn("id", ident)

    members = _led(made.select("id", F.explode("keys").alias("key")), settle=False)
    ids = members.select("id").distinct().join(made.select("id", "doc", "version", "pos"), "id")
    texts = materialize(_texts(docs, ids), "op6-texts")
    near = _near_lead(members, texts, threshold)
    near = _settled(members, near, texts, threshold)

    fate = made.join(near.withColumn("near", F.lit(True)), "id", "left").select("h", "g", F.col("doc").alias("d0"), F.col("version").alias("v0"), F.col("pos").alias("p0"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc", "version", "pos", "h", "g").join(fate, ["h", "g"]).where("near or doc <> d0 or version <> v0 or pos <> p0")
    return gone.groupBy("doc", "version").agg(F.collect_set("pos").alias("at"))  # at most a document's lines


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, every_length: bool = False) -> DataFrame:
    """``docs`` with the text's repeated lines removed, and n_lines, n_dropped.

    Lines end at \\n. Lines under ``min_chars`` characters stay; of the others,
    those go that have an equal line, or one within ``threshold`` edits, earlier
    by id and line number. With ``every_length`` the lines under ``min_chars``
    that are not blank go too, for equal ones only. Rows with the same id and text are one document, each losing
    the same lines; rows with the same id and different texts are documents of
    their own, in the order of their texts' hashes. Rows with a null id or text
    stay as they are (n_lines of a null text is 0). Columns of the new names
    are replaced, all others stay.
    """
    doc, version, at, parts = fresh(docs.columns, "_doc", "_version", "_at", "_lines")
    mine = versions(docs, id_col, text_col)
    gone = settled(lambda: duplicate_lines(docs, id_col, text_col, mine, threshold, min_chars, every_length), "op6-gone")  # the lines and their keys go
    out = docs.drop("n_lines", "n_dropped")
    out = out.join(gone.withColumnsRenamed({"doc": doc, "version": version, "at": at}), (F.col(id_col) == F.col(doc)) & (mine == F.col(version)), "left")
    out = out.withColumn(parts, F.split(text_col, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), at)  # by a hash set: linear in the lines
    kept = F.transform(stay, lambda i: F.get(parts, i))
    out = out.withColumn("n_lines", F.coalesce(F.size(parts), F.lit(0)).cast("long")).withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size(at), F.lit(0)).cast("long")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop(doc, version, at, parts)
