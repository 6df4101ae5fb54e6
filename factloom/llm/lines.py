"""Line dedup across documents: exact copies, and near copies by a segment-partition edit join.

Edits are counted in words for lines of ``MIN_WORDS`` words or more and in characters for
shorter ones; a line is compared with lines of its own kind. How many are allowed grows with
the shorter line (``allowed``): by words 1, and from 59 words on one for every ``RUN`` + 1
beyond the first ``RUN`` + 1, at most ``MOST``; by characters none below 16, 1 below 32, else 2.
Words are what stands between spaces.

A line with k edits allowed is split into k + 1 segments, one of which another line within k
edits contains whole. Segments are indexed, and lines probe the index with the substrings
that can match:

* characters: with the segment's number and the line's length; the substrings are those at
  places that the edits can have shifted a segment to, for the own and the shorter lengths;
* up to 39 words (one edit): the front and back halves, for the own length and one less;
* more words: every segment holds ``RUN`` words or more and is indexed by a substring of its
  first ``RUN`` words: the ``GRAM`` words from the one whose hash is least, the last three
  aside. A line probes with these substrings of all its windows of ``RUN`` words, so whole
  segments meet wherever they stand, with a key for about nine words. Length and place are
  compared as part of the join.

No table of all pairs under a key is made. First each line is compared with one line of its
key, the one that occurs most often; of the others only pairs that this has not put together
are compared, dealt by key, length and place. Where a key has many lines, as a passage that a
large part of them holds, two of them are compared only if one of the rarest tokens of each is
the same (of k + 1 rarest words k edits leave one), and lines with one edit allowed are not
compared at all but met by what they are without each of their tokens. Verified links are returned, which connect
all lines that any chain of pairs within the allowed edits connects.

Distances are banded and bit-parallel (``within``): a band of 61 rows as one long, a step for
each word or character, folded over the longer line by ``aggregate``.

Classes are the connected components of links and equal lines. The first line of a class, in
order of doc_id (null last), text and place, stays; the others go.

Only DataFrame functions are used. Lines and words are identified by 64-bit hashes. Defined
results: a null text stays null; a line without a word is neither compared nor dropped; rows
with equal doc_id and text are one document and get equal results; an empty table gives no
rows; columns of ``docs`` besides doc_id and text are carried in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.components import connected_components
from factloom.plans.shared import broadcast_if_small, materialize

MIN_WORDS = 12
RUN, GRAM = 19, 4
#: Edits allowed at most: a band of 2 * MOST + 1 rows is one long.
MOST = 30
_TOP = 2 * MOST
_ALL = (1 << (_TOP + 1)) - 1
#: Lines of so many words or more are indexed by least hashes.
_LONG = 2 * RUN + 1
_PLACE = (1 << 24) - 1
#: Pairs of lines in a group beyond which lines must also share a rare token.
_GROUP = 1 << 10
_WORD = r"[^\x20\x09-\x0D]"
_BLANK = r"[\x20\x09-\x0D]+"


def allowed(few: Column, n: Column) -> Column:
    """Edits for a shorter line of n characters (``few``) or words."""
    by_words = F.greatest(F.lit(1), F.least(F.lit(MOST), F.floor((n + 1) / (RUN + 1)).cast("int") - 1))
    return F.when(few, F.when(n < 16, 0).when(n < 32, 1).otherwise(2)).otherwise(by_words)


def _let(x: Column, use) -> Column:
    """``use(x)``, computing x once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether two arrays, longer than ``most``, are within ``most`` edits.

    Bit 60 of the band stands for row j + most of column j. Up to the last row the distance
    is followed down the diagonal, then along the last row.
    """
    flip = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(_ALL))
    left = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k.cast("int"))

    def distance(given: Column) -> Column:
        k, n = given["most"], given["n"]
        band = F.sequence(F.lit(0), 2 * k)
        # for each place of b, the rows of its band that hold the same
        equal = F.transform(b, lambda y, j: F.aggregate(band, F.lit(0).cast("long"), lambda m, t: F.when(F.get(a, j + k - t) == y, m.bitwiseOR(left(F.lit(_TOP) - t))).otherwise(m)))
        start = F.struct((F.lit(_ALL) - (left(F.lit(_TOP) - k) - 1)).alias("vp"), F.lit(0).cast("long").alias("vn"), k.cast("long").alias("d"), F.lit(0).alias("j"))

        def step(s: Column, x: Column) -> Column:
            def inner(d0: Column) -> Column:
                hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
                hn = d0.bitwiseAND(s["vp"])
                last = s["j"] - (n - k)  # columns since the band met the last row
                row = F.lit(_TOP - 1) - last
                d = s["d"] + F.when(last < 0, 1 - right(d0, F.lit(_TOP))).otherwise(right(hp, row).bitwiseAND(F.lit(1)) - right(hn, row).bitwiseAND(F.lit(1)))
                low = right(d0, F.lit(1))
                return F.struct(hn.bitwiseOR(flip(low.bitwiseOR(hp))).alias("vp"), low.bitwiseAND(hp).alias("vn"), d.alias("d"), (s["j"] + 1).alias("j"))

            d0 = (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(_ALL))
            return _let(d0, inner)

        return F.when(F.abs(n - F.size(b)) <= k, F.aggregate(equal, start, step, lambda s: s["d"]) <= k).otherwise(False)

    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _let(F.struct(most.cast("int").alias("most"), F.size(a).alias("n")), distance)


def _places(edits: int) -> list[tuple[int, int, int, bool]]:
    """``(segment, shorter by, shift, index)`` of a short line's own segments, which are the
    index, and of the other substrings that can match a segment of a line as long or shorter."""
    out = [(k, 0, 0, True) for k in range(edits + 1)]
    for less in range(edits + 1):
        for k in range(edits + 1):
            left, right = k, edits - k  # edits that can lie before and behind the segment
            out += [(k, less, shift, False) for shift in range(max(-left, less - right), min(left, less + right) + 1) if less or shift]
    return out


def _tokens() -> Column:
    """What the edits of a line are counted in, hashed: its words, or its characters."""
    return F.when(F.col("few"), F.transform(F.split("line", ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.transform("words", lambda w: F.xxhash64(w)))


def _measured(lines: DataFrame) -> DataFrame:
    """``lines(line, ...)`` with ``words``, ``few`` and ``n``."""
    d = lines.withColumn("words", F.split("line", " "))
    d = d.withColumn("few", F.size("words") < MIN_WORDS)
    return d.withColumn("n", F.when(F.col("few"), F.char_length("line")).otherwise(F.size("words")))


def keyed(lines: DataFrame) -> DataFrame:
    """``lines(line, ...)`` with ``few``, ``n`` and ``keys``, an array of ``(key, pos, index)``;
    ``pos`` is the substring's place, -1 for keys that have the place in them."""
    n, few = F.col("n"), F.col("few")
    key = lambda key, pos, index: F.struct(key.cast("long").alias("key"), F.lit(pos).cast("int").alias("pos"), F.lit(index).cast("boolean").alias("index"))

    def by_place(edits: int) -> Column:
        """Of the segments of a short line the last are the longer ones."""
        places = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(p, ("k", "less", "shift", "index"), strict=True)]) for p in _places(edits)])

        def cut(x: Column) -> Column:
            m = n - x["less"]
            base, short = F.floor(m / (edits + 1)).cast("int"), edits + 1 - m % (edits + 1)
            start = x["k"] * base + F.greatest(x["k"] - short, F.lit(0)) + x["shift"]
            return key(F.xxhash64(F.lit(2), x["k"], m, F.substring(F.col("line"), start + 1, base + (x["k"] >= short).cast("int"))), -1, x["index"])

        return F.transform(places, cut)

    # halves of a line with one edit
    half = lambda m: F.floor(m / 2).cast("int")
    front = lambda m: F.xxhash64(F.lit(0), m, F.slice("words", F.lit(1), half(m)))
    back = lambda m: F.xxhash64(F.lit(1), m, F.slice("words", n - (m - half(m)) + 1, m - half(m)))
    halves = F.array(key(front(n), -1, True), key(back(n), -1, True), key(front(n - 1), -1, False), key(back(n - 1), -1, False))
    # least words of windows by hash; the low bits hold the place, so the first of equals is least
    ranked = F.transform("words", lambda w, i: F.xxhash64(w).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
    least = lambda m, step: F.transform(m, lambda x, i: F.least(x, *[F.get(m, i + step * k) for k in (1, 2, 3)]))
    sixteen = _let(ranked, lambda p: _let(least(p, 1), lambda m: F.slice(least(m, 4), F.lit(1), n - (RUN - 1))))
    d = _measured(lines).withColumn("m", F.when(~few & (n >= _LONG), sixteen)).withColumn("k1", allowed(few, n) + 1)
    segments = F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda k: F.get("m", F.floor(k * n / F.col("k1")).cast("int")))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    long = _let(segments, lambda own: F.transform(F.array_distinct("m"), lambda x: key(F.xxhash64(*[F.get("words", place(x) + k) for k in range(GRAM)]), place(x), F.array_contains(own, x))))
    # a filter of lines without edits would be pushed below the split and split again
    none = F.array().cast("array<struct<key:long,pos:int,index:boolean>>")
    by_chars = F.when(n < 16, none).when(n < 32, by_place(1)).when(n == 32, F.concat(by_place(1), by_place(2))).otherwise(by_place(2))
    by_words = F.when(n < _LONG, halves).when(n == _LONG, F.concat(halves, long)).otherwise(long)
    return d.withColumn("keys", F.when(few, by_chars).otherwise(by_words)).drop("words", "m", "k1")


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a word: ``(doc_id, text_id, line_no, line, id)``."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return d.where(F.col("line").rlike(_WORD)).withColumn("id", F.xxhash64("line"))


def _near(n: str, pos: str, other_n: str, other_pos: str) -> Column:
    """Length and place of two keyed lines allow a link."""
    most = allowed(F.col("few"), F.least(n, other_n))
    return (F.abs(F.col(n) - F.col(other_n)) <= most) & (F.abs(F.col(pos) - F.col(other_pos)) <= most)


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are within the allowed edits."""
    a = broadcast_if_small(tokens).toDF("a", "few", "tokens_a")
    b = broadcast_if_small(tokens).drop("few").toDF("b", "tokens_b")
    most = allowed(F.col("few"), F.least(F.size("tokens_a"), F.size("tokens_b")))
    # an edit brings in one token at most that the other line lacks
    alike = (F.size(F.array_except("tokens_a", "tokens_b")) <= most) & (F.size(F.array_except("tokens_b", "tokens_a")) <= most)
    a_, b_ = F.col("tokens_a"), F.col("tokens_b")
    # most copies have few edits: a narrow band first
    near = F.when(alike, within(a_, b_, F.least(most, F.lit(3))) | ((most > 3) & within(a_, b_, most))).otherwise(False)
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def _tokens_of(lines: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``(id, few, tokens)`` of the lines with these ids, once each."""
    ids = materialize(ids.distinct(), f"{name}-ids")
    texts = _measured(lines.join(broadcast_if_small(ids), "id", "left_semi"))
    return materialize(texts.select("id", "few", _tokens().alias("tokens")).groupBy("id", "few").agg(F.first("tokens").alias("tokens")), f"{name}-tokens")


def _rare(tokens: DataFrame) -> DataFrame:
    """``(id, rare)``: of each line so many of its rarest tokens that two lines within the
    allowed edits have one in common. An edit takes a word away, or four runs of characters."""
    runs = F.transform(F.sequence(F.lit(1), F.size("tokens") - 3), lambda i: F.xxhash64(F.slice("tokens", i, F.lit(4))))
    most = allowed(F.col("few"), F.size("tokens")) * F.when(F.col("few"), 4).otherwise(1) + 1
    each = tokens.select("id", most.alias("most"), F.explode(F.array_distinct(F.when(F.col("few"), runs).otherwise(F.col("tokens")))).alias("rare"))
    often = materialize(each.groupBy("rare").agg(F.count("*").alias("times")).where("times > 1"), "often")
    each = each.join(broadcast_if_small(often), "rare", "left").select("id", "most", F.struct(F.coalesce("times", F.lit(1)).alias("times"), "rare").alias("t"))
    each = each.groupBy("id", "most").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return materialize(each.select("id", F.explode(F.slice("ts", F.lit(1), F.col("most"))).alias("t")).select("id", "t.rare"), "rare")


def one_edit_links(tokens: DataFrame) -> DataFrame:
    """``(id, few, tokens)`` -> links that connect the lines whose shorter one is allowed one
    edit, without comparing pairs: lines that are equal but for the token at the same place, each
    with the first of them, and lines that equal another one without a token."""
    last = F.when(F.col("few"), 32).otherwise(3 * (RUN + 1) - 1)
    short = tokens.where(F.size("tokens") <= last)
    whole = short.select(F.col("id").alias("b"), F.xxhash64("few", "tokens").alias("h"))
    cut = lambda i: F.xxhash64("few", F.concat(F.slice("tokens", F.lit(1), i - 1), F.slice("tokens", i + 1, F.size("tokens"))))
    less = short.select("id", "few", F.size("tokens").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens")), cut)).alias("i", "h"))
    same = less.where("n < if(few, 32, %d)" % (3 * (RUN + 1) - 1))
    firsts = materialize(same.groupBy("i", "h").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c"), "one-edit")
    same = same.join(broadcast_if_small(firsts), ["i", "h"]).where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")
    longer = less.join(whole, "h").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")
    return same.union(longer).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_links(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``lines(line, id)``, repeats and all -> links ``(a, b)`` between ids of different lines;
    ``found``: the stored table of ``keyed(lines)``."""
    found = materialize(keyed(lines).drop("line"), "keyed") if found is None else found
    keys = found.select("id", "few", "n", F.explode("keys").alias("x")).select("id", "few", "n", "x.*")
    met = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("index").alias("index")).where("lo < hi and index").select("key")
    met = materialize(met, "met")
    keys = keys.join(broadcast_if_small(met), "key", "left_semi")
    keys = materialize(keys.groupBy("id", "few", "n", "key", "pos", "index").agg(F.count("*").alias("times")), "shared-keys")

    # one line of each key
    middle = keys.where("index").groupBy("key").agg(F.max(F.struct("times", "id", "n", "pos")).alias("c"))
    middle = materialize(middle.select("key", F.col("c.id").alias("b"), F.col("c.n").alias("n_b"), F.col("c.pos").alias("pos_b")), "middle")
    pairs = keys.withColumnRenamed("id", "a").join(broadcast_if_small(middle), "key").where((F.col("a") != F.col("b")) & _near("n", "pos", "n_b", "pos_b"))
    pairs = materialize(pairs.select("a", "b").distinct(), "star-pairs")
    tokens = _tokens_of(lines, pairs.select(F.explode(F.array("a", "b")).alias("id")), "star")
    first = materialize(_verified(pairs, tokens), "star-links")

    # the others, but for pairs that these links connect already
    labels = materialize(connected_components(first).toDF("id", "label"), "star-labels")
    rest = keys.join(broadcast_if_small(labels), "id", "left").withColumn("label", F.coalesce("label", "id"))
    size = F.floor(F.log("n") / F.log(F.lit(1 + 1 / (RUN + 1)))).cast("int")
    wide = lambda c: F.ceil(F.pow(F.lit(1 + 1 / (RUN + 1)), c + 1) / (RUN + 1)).cast("int") + 1  # noqa: E731  # no fewer than the edits at that size
    cell = lambda c, d: F.struct(c.alias("size"), (F.floor(F.col("pos") / wide(c)) + d).cast("int").alias("cell"))
    around = F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda c: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(size + c, d))))
    one = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("cell")))
    long, group = F.col("pos") >= 0, ["key", "size", "cell"]
    index = rest.where("index").select("key", F.inline(F.when(long, around).otherwise(one)), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("label").alias("label_b"))
    probe = rest.select("key", F.inline(F.when(long, F.array(cell(size, F.lit(0)))).otherwise(one)), F.col("id").alias("a"), "few", "n", "pos", "label")
    counts = probe.groupBy(group).agg(F.count("*").alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).join(index.groupBy(group).agg(F.count("*").alias("q"), F.min("label_b").alias("lo_b"), F.max("label_b").alias("hi_b")), group)
    counts = counts.where(F.least("lo", "lo_b") < F.greatest("hi", "hi_b"))
    counts = materialize(counts.select(*group, (F.col("p") * F.col("q") > _GROUP).alias("large")), "groups")
    small, large = (broadcast_if_small(materialize(counts.where(w).select(*group), "some")) for w in ("not large", "large"))
    meets = (F.col("label") != F.col("label_b")) & _near("n", "pos", "n_b", "pos_b")
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    pairs = materialize(probe.join(small, group, "left_semi").join(index, group).where(meets).select(*ordered).distinct(), "pairs")
    # where many meet, as at a passage that all have, also their rarest tokens must
    probe = materialize(probe.join(large, group, "left_semi"), "probe")
    index = materialize(index.join(large, group, "left_semi"), "index")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(probe.select("a")).union(index.select("b"))
    tokens = _tokens_of(lines, ids, "pair")
    crowd = materialize(probe.select(F.col("a").alias("id")).union(index.select("b")).distinct(), "crowd")
    crowd = materialize(tokens.join(broadcast_if_small(crowd), "id", "left_semi"), "crowd-tokens")
    rare = _rare(crowd.where(allowed(F.col("few"), F.size("tokens")) > 1))
    more = probe.join(broadcast_if_small(rare).withColumnRenamed("id", "a"), "a").join(index.join(broadcast_if_small(rare).withColumnRenamed("id", "b"), "b"), [*group, "rare"])
    pairs = pairs.union(more.where(meets).select(*ordered)).distinct()
    return first.select(*ordered).union(_verified(pairs, tokens)).union(one_edit_links(crowd)).distinct()


def shared_lines(docs: DataFrame) -> DataFrame:
    """Lines whose class has another: ``(doc_id, text_id, lines)``, ``lines`` an array of
    ``(line_no, class, kept, near)``; near: the line differs from the one that stays."""
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = occurrences(d)
    found = materialize(keyed(texts).drop("line"), "keyed")
    roots = materialize(connected_components(near_links(texts.select("line", "id"), found)), "classes").withColumnRenamed("node", "id")
    place = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "text_id", "line_no", "id")
    # rows that are equal in id and text are one document: a line counts once for each place
    ids = found.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ids = ids.join(roots, "id", "left").withColumn("class", F.coalesce("root", "id"))
    ids = materialize(ids.select("id", "class", "first", (F.col("first") != F.col("last")).alias("again")), "line-ids")
    classes = ids.groupBy("class").agg(F.min("first").alias("first"), F.max("again").alias("again"), F.count("*").alias("n")).where("n > 1 or again").select("class", "first")
    shared = materialize(ids.select("id", "class").join(classes, "class"), "shared-lines")
    rows = found.select("doc_id", "text_id", "line_no", "id").join(broadcast_if_small(shared), "id")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id")) & (F.col("line_no") == F.col("first.line_no"))
    mark = F.struct("line_no", "class", kept.alias("kept"), (F.col("id") != F.col("first.id")).alias("near"))
    return rows.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set(mark)).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, ...)``: ``row`` (the input row), ``n_lines``,
    ``n_removed``, ``n_near`` (removed and not equal to the line that stays), ``kept_text``,
    ``lines`` (as in ``shared_lines``) and ``emptied`` (lost lines and has no word left)."""
    marks = materialize(shared_lines(docs).withColumnsRenamed({"doc_id": "of_doc", "text_id": "of_text"}), "marks")
    text = F.col("text").cast("string")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_doc"), text.alias("own"), F.xxhash64(text).alias("own_text"))
    d = d.join(broadcast_if_small(marks), (F.col("own_text") == F.col("of_text")) & F.col("own_doc").eqNullSafe(F.col("of_doc")), "left")
    gone = F.filter("lines", lambda x: ~x["kept"])
    d = d.select("row", "own", F.split("own", "\n", -1).alias("all"), "lines", gone.alias("gone"))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.transform("gone", lambda x: x["line_no"]))
    left = F.array_join(F.transform(places, lambda i: F.get("all", i)), "\n")
    kept = F.when(F.size("gone") > 0, left).otherwise(F.col("own"))
    n_gone = F.greatest(F.size("gone"), F.lit(0)).cast("long")
    return d.select(
        "row",
        F.greatest(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        n_gone.alias("n_removed"),
        F.greatest(F.size(F.filter("gone", lambda x: x["near"])), F.lit(0)).cast("long").alias("n_near"),
        kept.alias("kept_text"),
        F.coalesce("lines", F.array().cast("array<struct<line_no:int,class:long,kept:boolean,near:boolean>>")).alias("lines"),
    ).withColumn("emptied", (F.col("n_removed") > 0) & ~F.col("kept_text").rlike(_WORD))


def strip_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text`` (and ``n_chars``, if there, set
    anew); documents left without a word go."""
    new = {"text": F.col("kept_text")} | ({"n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    found = dedup_lines(docs).where(~F.coalesce("emptied", F.lit(False)))
    return found.select(*[new.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
