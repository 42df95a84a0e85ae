"""Line dedup by winnowing, in column expressions.

A text is the sequence of the words of its lines. A word is an anchor if its hash is in the lowest eighth. Every window of RUN
words is represented by one of its first RUN - GRAM + 1 words: the first anchor, or the last of them if none is one. The
consecutive windows that share a representative are a stretch; its fingerprint is the hash of the GRAM words from the representative
on. All this depends on the words of the window only, so a passage of RUN words or more has the same representatives wherever it stands:
no repeated passage goes unseen, in whatever script, and whatever lines it is cut into.

Stretches are compared as a whole first: one whose words are those of a stretch of an earlier document is repeated altogether.
Where different stretches have one fingerprint, and where a document repeats a stretch of its own, the windows are compared one by one.
Windows that occurred at an earlier place are deleted, together they are the repeated runs, word by word. The order of places is (doc_id, hash of
the text, word). A line is not compared with itself.

Words, stretches and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RUN = 50        # words of the shortest run that is deleted
GRAM = 26       # words of a fingerprint; RUN - GRAM + 1 words can represent a window
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# The white space that is neither a space nor a line break, and all of it, as patterns: single letters are looked up in one table,
# one range tells that a letter is none of the wide spaces.
RARE = r"[\t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
WHITE = r"[ \n" + RARE[1:]
ANCHORS = -(3 << 61)        # hashes below are anchors, one in eight
DOC = ["id", "th"]


def _doc(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")


def _rare(text: Column) -> Column:
    """Whether a text has white space that is neither a space nor a line break. The pattern is for texts with a letter that begins like one."""
    letters = [F.contains(text.cast("binary"), F.lit(x)) for x in sorted({c.encode()[:2] for c in SPACES if c not in " \n"})]
    return functools.reduce(lambda a, b: a | b, letters) & text.rlike(RARE)


def _words(text: str | Column) -> Column:
    """The words of a text. Texts with no white space but spaces and line breaks are split without a pattern."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    return F.array_remove(F.when(_rare(text), F.split(text, WHITE)).otherwise(plain), "")


def stretches(documents: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """id, th, at, n, g, z, apart: of each stretch the first window, the number of windows, the fingerprint and the hash of all words.

    ``apart`` is 0 unless the first four words of the fingerprint all occur again within half its length, as they do where a few
    words are repeated on and on. Such a fingerprint can be that of every window of a text; there it is a hash of the place.
    """
    wide = run - gram + 1
    rows = _doc(documents).select(*DOC, F.transform(_words("text"), lambda w: F.xxhash64(w)).alias("h"))
    anchors = F.array_remove(F.transform("h", lambda x, i: F.when(x < ANCHORS, i).otherwise(-1)), -1)
    rows = rows.select(*DOC, "h", F.concat(F.array(F.lit(-1)), anchors, F.array(F.size("h"))).alias("a"))
    # Outer, as otherwise the optimizer derives a filter that splits and hashes each text once more.
    rows = rows.select(*DOC, "h", "a", F.posexplode_outer("a").alias("i", "before"))
    after, last = F.coalesce(F.get("a", F.col("i") + 1), F.lit(-1)), F.size("h") - run        # the next anchor, the last window
    rows = rows.select(*DOC, "h", after.alias("after"), last.alias("last"), (F.col("before") + 1).alias("at"))
    # A stretch begins behind each anchor; where none follows in reach, each window is one.
    each = F.sequence(F.col("at"), F.least(F.col("last"), F.greatest(F.col("at"), F.col("after") - (wide - 1))))
    rows = rows.select(*DOC, "h", "after", "last", F.explode_outer(F.when((F.col("at") <= F.col("last")) & (F.col("after") >= 0), each)).alias("at"))
    rows = rows.where(F.col("at").isNotNull())
    near = F.col("after") - F.col("at") < wide
    n = F.when(near, F.least(F.col("after"), F.col("last")) - F.col("at") + 1).otherwise(1)
    gram_at = F.when(near, F.col("after") + 1).otherwise(F.col("at") + wide)
    rows = rows.select(*DOC, "h", "at", n.alias("n"), gram_at.alias("gram_at"))
    apart = F.lit(True)
    for k in range(4):
        apart = apart & F.array_contains(F.slice("h", F.col("gram_at") + (k + 1), max(0, min(gram // 2, gram - 4))), F.get("h", F.col("gram_at") + (k - 1)))
    return rows.select(*DOC, "at", "n", F.xxhash64(F.slice("h", "gram_at", gram)).alias("g"),
                       F.xxhash64(F.slice("h", F.col("at") + 1, F.col("n") + (run - 1))).alias("z"),
                       F.when(apart, F.xxhash64(*DOC, "at")).otherwise(0).alias("apart"))


def _windows(documents: DataFrame, marks: DataFrame, run: int) -> DataFrame:
    """id, th, at, line, w: the windows of the marked stretches with the numbers of the lines they begin on and their hashes."""
    wanted = marks.groupBy(*DOC).agg(F.collect_set(F.struct("at", "n")).alias("marks"))
    texts = _doc(documents)
    texts = texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["id"]) & (texts["th"] == wanted["th"])).select(texts["id"], texts["th"], "text", "marks")
    lines = texts.select(*DOC, "marks", F.filter(F.transform(F.split("text", "\n"), _words), lambda x: F.size(x) > 0).alias("lines"))
    rows = lines.select(*DOC, "marks", F.transform(F.flatten("lines"), lambda w: F.xxhash64(w)).alias("h"),
                        F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i, F.size(x)))).alias("line"))
    rows = rows.select(*DOC, "h", "line", F.explode_outer("marks").alias("m"))
    rows = rows.select(*DOC, "h", "line", F.explode_outer(F.sequence(F.col("m.at"), F.col("m.at") + F.col("m.n") - 1)).alias("at"))
    return rows.select(*DOC, "at", F.get("line", F.col("at")).alias("line"), F.xxhash64(F.slice("h", F.col("at") + 1, run)).alias("w"))


def repeated_runs(documents: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """id, th, runs: for documents that repeat something, the first word and the end of every run to delete, in order."""
    # Places, first places and runs grow with the documents: no broadcast, and the same plan at every size.
    # One pass over the texts and one shuffle tell which fingerprints are repeated, whether their stretches differ, and the first place
    # of each stretch. Places apart are kept all, and dealt one by one: ``g`` is the fingerprint, changed by the place for these only.
    group = Window.partitionBy("g")
    stretch = Window.partitionBy("g", "z").orderBy(*DOC, "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = stretches(documents, run, gram).withColumn("g", F.col("g").bitwiseXOR(F.col("apart")))
    places = places.select("*", F.count("*").over(group).alias("places"), (F.min("z").over(group) != F.max("z").over(group)).alias("unlike"))
    places = places.where("places > 1 OR apart != 0").select("*", *(F.first(c).over(stretch).alias(f"f_{c}") for c in (*DOC, "at")))
    own = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th"))
    far = F.col("apart") != 0
    places = places.select(*DOC, "at", "n", F.when(far, F.col("g").bitwiseXOR(F.col("apart"))).alias("g"), F.when(far, F.col("z")).alias("z"), far.alias("apart"),
                           "unlike", own.alias("own"), F.col("f_at").alias("first"))
    places = stored(places, "places")
    head = F.col("own") & (F.col("at") == F.col("first"))
    near = places.where("NOT apart")
    places = places.where("apart").select(*DOC, "at", "n", "g", "z")
    # Apart, the first place of each stretch is a partial aggregation, so that a stretch of very many documents is one row a task.
    first = stored(places.groupBy("z", "g").agg(F.min(F.struct(*DOC, "at", "n")).alias("f")), "first-places")
    own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th"))
    later = places.join(first.select("z", "f").hint("merge"), "z").where(~F.struct(*DOC, "at").eqNullSafe(F.struct("f.id", "f.th", "f.at")))
    later = stored(later.select(*DOC, "at", "n", own.alias("own"), F.col("f.at").alias("first")), "later-places")
    later = later.unionByName(near.where(~head).select(*DOC, "at", "n", "own", "first"))
    unlike = first.groupBy("g").agg(F.count("*").alias("stretches")).where("stretches > 1").select("g")
    marks = first.join(unlike.hint("merge"), "g").select("f.*").unionByName(near.where(F.col("unlike") & head).select(*DOC, "at", "n"))
    selves = later.where("own")
    marks = marks.unionByName(selves.select(*DOC, "at", "n")).unionByName(selves.select(*DOC, F.col("first").alias("at"), "n"))
    windows = stored(_windows(documents, marks, run), "windows")
    heads = windows.groupBy("w").agg(F.min(F.struct(*DOC, "at", "line")).alias("f"), F.count("*").alias("places")).where("places > 1").drop("places")
    same_line = own & (F.col("line") == F.col("f.line"))        # the first place itself is on its own line
    others = windows.join(heads.hint("merge"), "w").where(~same_line).select(*DOC, "at", F.lit(1).alias("n"))
    found = later.where("NOT own").select(*DOC, "at", "n").unionByName(others)
    # Runs of windows: the end of what was found before, in the order of the places, tells where a run begins.
    found = found.groupBy(*DOC).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("s"))
    begins = F.filter("s", lambda x, i: (i == 0) | (x > F.get("s", i - 1) + run))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1) > x + run))
    return found.select(*DOC, F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), (b + run).alias("end"))).alias("runs"))


def _left_over(text: str, runs: str) -> Column:
    """The text without the words of its runs; null if it has none. A word goes with the white space behind it, but a line break behind a run stays."""
    body = F.ltrim(text, F.lit(SPACES))
    # Words, each with the white space behind it.
    tokens = F.split(body, f"(?<={WHITE})(?=[^{WHITE[1:]})")

    def kept(tokens: Column) -> Column:
        n = F.size(tokens)

        def part(i: Column) -> Column:
            """What stays before run i; after the last run, the rest."""
            at = F.when(i == 0, 0).otherwise(F.get(F.transform(runs, lambda r: r["end"]), i - 1))
            run = F.get(runs, i)
            last = F.get(tokens, run["first"] - 1)
            word = F.rtrim(last, F.lit(SPACES))
            gap = F.substring(last, F.length(word) + 1, F.length(last))
            gap = F.when(F.get(tokens, run["end"] - 1).contains("\n") & ~gap.contains("\n"), "\n").otherwise(gap)
            before = F.concat(F.array_join(F.slice(tokens, at + 1, run["first"] - at - 1), ""), word, F.when(run["end"] >= n, "").otherwise(gap))
            return F.when(i == F.size(runs), F.array_join(F.slice(tokens, at + 1, F.greatest(n - at, F.lit(0))), "")).when(run["first"] > at, before).otherwise("")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs)), part), "")

    # A transform over one element computes the tokens once.
    left = F.get(F.transform(F.array(tokens), kept), 0)
    lead = F.substring(text, F.lit(1), F.length(text) - F.length(body))
    return F.when(F.col(runs).isNotNull(), F.get(F.transform(F.array(left), lambda x: F.when(x == "", "").otherwise(F.concat(lead, x))), 0))


def _lines(text: str) -> Column:
    """The number of lines: one more than line breaks."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def without_repeated_lines(documents: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """All rows and columns, with ``text`` cleaned, plus _llm_lines and _llm_deleted, the numbers of lines before and deleted.

    Null texts stay null. A line that loses all its words is deleted, one that loses a part only is not. Blank lines behind a run go
    with it. A document that had words and has none left becomes the empty text. Rows repeated in full get the same result, each;
    null ids come first in the order of places. An empty table gives an empty one.
    """
    runs = stored(repeated_runs(documents, run, gram), "runs").select(F.col("id").alias("_llm_id"), F.col("th").alias("_llm_th"), F.col("runs").alias("_llm_runs"))
    rows = documents.withColumn("_llm_th0", F.xxhash64("text"))
    rows = rows.join(runs.hint("merge"), rows["doc_id"].eqNullSafe(runs["_llm_id"]) & (rows["_llm_th0"] == runs["_llm_th"]), "left")
    rows = rows.withColumn("_llm_cut", _left_over("text", "_llm_runs"))
    lines = F.coalesce(_lines("text"), F.lit(0))
    left = F.when(F.col("_llm_cut").isNull(), lines).when(F.col("_llm_cut") == "", 0).otherwise(_lines("_llm_cut"))
    text = F.coalesce("_llm_cut", "text").alias("text")
    return rows.select(*(text if c == "text" else F.col(c) for c in documents.columns), lines.alias("_llm_lines"), (lines - left).alias("_llm_deleted"))


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, text_sha256 of the cleaned text (null for a null text)."""
    done = without_repeated_lines(documents.select("doc_id", "text"))
    return done.select("doc_id", F.col("_llm_lines").cast("long").alias("n_lines"), F.col("_llm_deleted").cast("long").alias("n_deleted"),
                       F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))
