"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words (runs outside ASCII white space). Lines of equal words are copies, however short. Two other lines are
copies if at most one word must be inserted, deleted or replaced to turn one into the other, and that word is at most a
tenth of each (`near_words` = 10 words at least): in shorter lines a word is too much of what they say, and under two words
any two lines would be copies. The deletion neighbourhood of a line is itself and all its variants without one word, as
hashed keys; equal keys are brought together and the edit is verified on the words. The earliest line of a group is found
by a minimum, which every other line is then compared with, so that a group of any size costs one pair for each line.

Only lines that can have a partner emit their variants: one edit leaves the first or the last half of the words alone, so
a line that shares neither of its halves with another line has none, and one that shares its first half only needs the
variants without a word of its last. This loses no pair, and saves most keys. Two different lines whose 64-bit keys are
equal by chance could hide a pair behind a failed comparison; among 10^9 keys that happens to one group in 40.

A line is dropped if an earlier line is its copy, be that line dropped itself or not. Earlier means: by document id (null
last), then by a hash of the text, then by place.

Defined cases: null text stays null; an empty text and lines without a word stay; a document of which all words went is
dropped, as all of it is kept elsewhere; repeated rows (equal id and text) are one document, and all its rows stay and get
the same text; an empty table gives no rows; extra columns stay and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.storage import written

NEAR_WORDS = 10
#: Words whose running XORs are held in one array.
PIECE = 256
LINE = ["h1", "h2"]


def _blanks(text: Column) -> Column:
    """text with a blank for all white space but line ends. Few texts have any other, and translate looks at each letter."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.translate(text, "\t\x0b\f\r", "    ")).otherwise(text)


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "idx")


def _halves() -> list[Column]:
    """Hashes of the first and last halves; odd lines have two sizes of a half, as a partner may have a word more."""
    low, high, n, w = F.expr("n div 2").cast("int"), F.expr("(n + 1) div 2").cast("int"), F.col("n"), "words"
    out = [F.xxhash64(F.lit(2), F.slice(w, F.lit(1), low)), F.xxhash64(F.lit(3), F.slice(w, n - low + 1, low))]
    return out + [F.when(low != high, F.xxhash64(F.lit(2), F.slice(w, F.lit(1), high))), F.when(low != high, F.xxhash64(F.lit(3), F.slice(w, n - high + 1, high)))]


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) -> doc_id, th, idx, n of each line, two hashes that name its words, and those of its halves.
    Lines without words are among them, as a filter here would split each line twice."""
    rows = docs.select("doc_id", "th", _blanks(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where("line <> ''")
    rows = rows.select("doc_id", "th", "idx", _words(F.col("line")).alias("words")).withColumn("n", F.size("words"))
    rows = rows.select("doc_id", "th", "idx", "n", F.xxhash64("words").alias("h1"), *[k.alias(f"k{i}") for i, k in enumerate(_halves())])
    # the first half and the rest name the words as well
    return rows.withColumn("h2", F.xxhash64(F.lit(1), "n", "k0", F.coalesce("k3", "k1")))


def _variants(rows: DataFrame) -> DataFrame:
    """Keys of the lines (h1, h2, ord, n, words, low, high): key and m, the words it covers; pos, the word left out, or -1.
    Words from `low` on and before `high` are left out, one at a time. A key is the XOR of hashes of (word, place); running
    XORs, over `PIECE` words at a time and over the pieces of a line, give each variant in constant time."""
    zero = F.array(F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g")))
    last = lambda runs: F.element_at(runs, -1)
    at = lambda runs, less: F.col("start") + F.size(runs) - less
    step = lambda runs, w: F.array_append(runs, F.struct(last(runs)["f"].bitwiseXOR(F.xxhash64(w, at(runs, 1))).alias("f"), last(runs)["g"].bitwiseXOR(F.xxhash64(w, at(runs, 2))).alias("g")))
    given = [*LINE, "ord", "n", "low", "high", "start"]
    one = rows.where(F.col("n") <= PIECE).withColumn("start", F.lit(0)).select(*given, F.aggregate("words", zero, step).alias("runs"))
    one = one.withColumns({"f": F.lit(0).cast("long"), "g": F.lit(0).cast("long"), "all_g": F.element_at("runs", -1)["g"]})
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE)), lambda i: F.struct(i.alias("start"), F.slice("words", i + 1, F.lit(PIECE)).alias("piece")))
    many = rows.where(F.col("n") > PIECE).select(*LINE, "ord", "n", "low", "high", F.inline(pieces)).select(*given, F.aggregate("piece", zero, step).alias("runs"))
    line, own = Window.partitionBy(*LINE), lambda c: F.element_at("runs", -1)[c]
    before = lambda c: F.bit_xor(own(c)).over(line.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)).bitwiseXOR(own(c))
    many = many.withColumns({"f": before("f"), "g": before("g"), "all_g": F.bit_xor(own("g")).over(line)})
    both = one.unionByName(many)
    wanted = F.filter(F.sequence(F.lit(0), F.size("runs") - 2), lambda i: (F.col("start") + i >= F.col("low")) | (F.col("start") + i < F.col("high")))
    key = lambda i: F.col("f").bitwiseXOR(F.get("runs", i)["f"]).bitwiseXOR(F.col("all_g")).bitwiseXOR(F.col("g")).bitwiseXOR(F.get("runs", i + 1)["g"])
    made = F.transform(wanted, lambda i: F.struct((F.col("start") + i).alias("pos"), key(i).alias("key"), (F.col("n") - 1).alias("m")))
    whole = F.struct(F.lit(-1).alias("pos"), F.col("f").bitwiseXOR(own("f")).alias("key"), F.col("n").alias("m"))
    ends = F.filter(F.array(F.when(F.col("start") + PIECE >= F.col("n"), whole)), lambda x: x.isNotNull())
    return both.select(*LINE, "ord", F.inline(F.concat(made, ends)))


def _without(words: Column, pos: Column) -> Column:
    """words without the one at pos, or all if pos is -1."""
    return F.when(pos < 0, words).otherwise(F.concat(F.slice(words, F.lit(1), pos), F.slice(words, pos + 2, F.size(words))))


def _able(distinct: DataFrame) -> DataFrame:
    """Lines that share a half with another line: h1, h2, and low and high, between which no edit can be."""
    n, half = F.col("n"), F.array(*[F.struct(F.lit(i % 2).alias("last"), F.expr(f"(n + {i // 2}) div 2").cast("int").alias("size"), F.col(f"k{i}").alias("k")) for i in range(4)])
    halves = distinct.select(*LINE, "n", F.inline(half)).where("k is not null")
    shared = halves.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    found = halves.join(shared, "k", "left_semi")
    return found.groupBy(*LINE).agg(F.min(F.when(F.col("last") == 0, F.col("size")).otherwise(n)).alias("low"), F.max(F.when(F.col("last") == 1, n - F.col("size")).otherwise(0)).alias("high"))


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that are near copies of an earlier one."""
    able = written(distinct.join(_able(distinct), LINE).select(*LINE, "ord", "n", "low", "high"), "able")

    # words of the lines that can have a partner, from the document that has each first; lists by document, so that a
    # text is split once and moves only as often as it is there
    listed = able.groupBy(F.col("ord.doc_id").alias("of_id"), F.col("ord.th").alias("of_th")).agg(F.collect_list(F.struct("ord", *LINE, "n", "low", "high")).alias("asked"))
    both = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")))
    both = both.select("asked", F.split(_blanks(F.col("text")), "\n").alias("lines"))
    picked = F.transform("asked", lambda a: F.struct(*[a[c].alias(c) for c in ("ord", *LINE, "n", "low", "high")], F.get("lines", a["ord"]["idx"]).alias("line")))
    texts = both.select(F.inline(picked)).select(*LINE, "ord", "n", "low", "high", _words(F.col("line")).alias("words"))
    texts = written(texts.dropDuplicates(LINE), "texts")

    keys = written(_variants(texts), "variants")
    met = keys.groupBy("key", "m").agg(F.min(F.when(F.col("pos") < 0, F.col("ord"))).alias("whole"), F.count("*").alias("c")).where("c > 1")
    keys = written(keys.join(met.drop("c"), ["key", "m"]), "met")
    # replaced word: the earliest line that lacks a word at the same place; missing word: the earliest with one more
    group = keys.groupBy("key", "m", "pos").agg(F.min(F.struct("ord", *LINE)).alias("least"))
    spare = group.where("pos >= 0").groupBy("key", "m").agg(F.min(F.struct("least", "pos")).alias("longer"))
    replaced = keys.where("pos >= 0").join(group, ["key", "m", "pos"]).where("least.ord < ord").select(*LINE, F.col("least.h1").alias("o1"), F.col("least.h2").alias("o2"), F.col("pos").alias("p"), F.col("pos").alias("q"))
    first = group.where("pos < 0").select("key", "m", F.col("least").alias("short"))
    shorter = keys.where("pos >= 0 and whole < ord").join(first, ["key", "m"]).select(*LINE, F.col("short.h1").alias("o1"), F.col("short.h2").alias("o2"), F.col("pos").alias("p"), F.lit(-1).alias("q"))
    longer = keys.where("pos < 0").join(spare, ["key", "m"]).where("longer.least.ord < ord").select(*LINE, F.col("longer.least.h1").alias("o1"), F.col("longer.least.h2").alias("o2"), F.lit(-1).alias("p"), F.col("longer.pos").alias("q"))
    pairs = replaced.unionByName(shorter).unionByName(longer).distinct()
    ours = texts.select(*LINE, F.col("words").alias("a"))
    theirs = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("b"))
    return pairs.join(ours, LINE).join(theirs, ["o1", "o2"]).where(_without(F.col("a"), F.col("p")) == _without(F.col("b"), F.col("q"))).select(*LINE).distinct()


def duplicates(docs: DataFrame, *, near: bool = True, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, th, text) -> (doc_id, th, idx) of the lines that go."""
    table = written(lines(docs), "lines").where("n > 0")
    distinct = table.groupBy(*LINE).agg(F.min(_order()).alias("ord"), F.count("*").alias("c"), F.any_value("n").alias("n"), *[F.any_value(f"k{i}").alias(f"k{i}") for i in range(4)])
    distinct = written(distinct, "distinct")
    again = distinct.select(*LINE, F.col("ord").alias("first"), "c")
    if near:
        copies = written(_near(docs, distinct.where(F.col("n") >= near_words)), "copies")
        again = again.join(copies.withColumn("copy", F.lit(True)), LINE, "left")
    else:
        again = again.withColumn("copy", F.lit(None).cast("boolean"))
    # of a near copy every line goes; of others all but the first
    again = again.where("c > 1 or copy").drop("c")
    return written(table.select("doc_id", "th", "idx", *LINE).join(again, LINE).where(F.col("copy").isNotNull() | (_order() > F.col("first"))).select("doc_id", "th", "idx").distinct(), "dropped")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))


def _dropped_places(docs: DataFrame, near: bool, near_words: int) -> DataFrame:
    gone = duplicates(docs, near=near, near_words=near_words)
    return gone.groupBy(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th")).agg(F.sort_array(F.collect_list("idx")).alias("gone"))


def _kept_text(lines_: Column, gone: Column) -> Column:
    places = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), gone)
    return F.array_join(F.transform(places, lambda i: F.get(lines_, i)), "\n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near: bool = True, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs with the lines that an earlier line copies taken out of the texts."""
    gone = _dropped_places(_keyed(docs, id_col, text_col), near, near_words)
    names = [f"c{k}" for k in range(len(docs.columns))]
    id_, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    both = docs.toDF(*names).withColumn("th", F.xxhash64(text)).join(gone, id_.eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")), "left")
    # a column of its own, as within the function below it would be split again for each line
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    both = both.withColumn("kept", F.when(F.col("gone").isNull(), text).otherwise(_kept_text(F.col("lines"), F.col("gone"))))
    both = both.where(F.col("gone").isNull() | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    return both.select(*[(F.col("kept") if c == text_col else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near: bool = True, near_words: int = NEAR_WORDS) -> DataFrame:
    """For each document doc_id, n_lines, n_dropped, and the places of the dropped lines as text."""
    keyed = _keyed(docs, id_col, text_col)
    gone = _dropped_places(keyed, near, near_words)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    rows = keyed.select("doc_id", "th", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("th") == F.col("of_th")), "left")
    dropped = F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit(""))
    return both.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), dropped.alias("dropped"))
