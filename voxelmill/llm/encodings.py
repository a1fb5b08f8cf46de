"""Text garbled by a wrong decoding: found through clean near-twins, restored where that is possible."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# The public encodings that a wrong decoding is looked for in.
ENCODINGS = [
    "utf-8", "latin-1", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-15",
    "koi8-r", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "mac_latin2",
]

#: Pieces of one place up to which all of them are paired; in places of more, those that a decoding or a letter tells are met by equality, which gives the same mappings.
CROWD = 64
#: How many times as many documents as the garbled form the clean one has where few documents are enough to tell them apart.
RATIO = 3.0
#: Standard deviations by which clean documents outnumber garbled ones (or, for single words, garbled may outnumber clean ones).
SURE, SLACK = 3.0, 2.0
#: Share of a decoding's documents that is garbled from which its reverse is only learned from sure mappings.
SKEWED = 0.05
#: Distinct mappings that a transformation must explain beyond those learned before it.
MAPPINGS = 3
#: Characters of the longest piece that stands for one letter: four bytes, each decoded wrongly twice.
PIECE = 8
#: How often a text may have been decoded wrongly in the same way.
DEPTH = 2

#: Letters, digits, inner dots and non-ASCII characters in a row, at least one of them non-ASCII.
RUN = (
    r"(?<![A-Za-z0-9])(?:[A-Za-z0-9][A-Za-z0-9.]*+)?+[^\x00-\x7F]"
    r"(?:[A-Za-z0-9.\x{80}-\x{10FFFF}]*[A-Za-z0-9\x{80}-\x{10FFFF}])?"
)
#: Runs whose non-ASCII characters are no letters and stand in two places or more, such as quoted names.
MARKED = r"^[A-Za-z0-9.]*+[^\p{L}\x00-\x7F]+[A-Za-z0-9.]++(?:[^\p{L}\x00-\x7F]+[A-Za-z0-9.]*+)+$"

#: One-byte encodings that agree in most letters.
KIN = {"latin-1": "cp1252", "iso8859-15": "cp1252", "cp1254": "cp1252", "iso8859-2": "cp1250"}
#: Non-ASCII characters that undone UTF-8 may have in a run, by script (punctuation and signs go with each).
SCRIPTS = re.compile(
    "(?:[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f\u01a0\u01a1\u01af\u01b0\u0218-\u021b\u0259\u1ea0-\u1ef9]*|[\u0386\u0388-\u03ce]*|[\u0400-\u045f\u0490\u0491]*"
    "|[\u05d0-\u05ea]*|[\u0621-\u0652\u067e-\u06cc]*|[\u0e01-\u0e4e]*|[\u3041-\u30fe\u4e00-\u9fff]*|[\uac00-\ud7a3]*)"
)
SIGNS = re.compile("[\u00a1\u00a3\u00a7\u00a9-\u00ab\u00ae\u00b0\u00ba\u00bb\u00bf\u2010-\u2026\u20ac\u2122\u2669-\u266f\u3001-\u3011\uff01-\uff1f]")


def _byte_tables() -> dict[str, dict[str, int]]:
    """For each one-byte encoding the byte of each character; undefined bytes stand for the control character of their number."""
    out = {}
    for name in ENCODINGS:
        if name != "utf-8":
            known = {b: bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)}
            out[name] = {c: b for b, c in sorted(known.items(), reverse=True)}
    return out


def undoing() -> Callable[[str, str, str], str | None]:
    """A function of ``(text, wrong, right)``: the text that was in ``right`` before its bytes were read as ``wrong``, or None."""
    tables = _byte_tables()
    signs = {n: {b: c for c, b in t.items()} for n, t in tables.items()}

    def undo(text: str, wrong: str, right: str) -> str | None:
        try:
            if wrong == "utf-8":
                data = text.encode("utf-8")
            else:
                table = tables[wrong]
                data = bytes([table[c] for c in text])
            return data.decode("utf-8") if right == "utf-8" else "".join([signs[right][b] for b in data])
        except (KeyError, UnicodeError):
            return None

    return undo


def strict(run: str, clean: str) -> bool:
    """Whether ``clean``, whose UTF-8 bytes were read as ``run``, shows by itself that they were: all of it is plausible text of one
    script, and the run has a sign that is no letter (nor the mark that ends a word), or at least two characters are whole sequences of bytes."""
    beyond = [c for c in clean if c > "\x7f"]
    letters = "".join(c for c in beyond if not SIGNS.match(c))
    if not beyond or len(clean) >= len(run) or not SCRIPTS.fullmatch(letters) or (letters > "\u0380" and re.search("[A-Za-z]", clean)):
        return False
    if len(beyond) == 1 and re.search("[\u00a0\u00ab\u00bb\u2010-\u203a]$", run):  # a letter and a mark after it
        return False
    odd = any(c > "\x7f" and not c.isalpha() for c in run)
    return odd if len(beyond) == 1 else odd or len(beyond) > 2


def outweighs(m: Column, n: Column) -> Column:
    """Whether ``m`` clean documents tell that ``n`` others are the garbled ones: by ``RATIO``, or by ``SURE`` standard deviations."""
    return (m >= n * RATIO) | sure(m, n)


def sure(m: Column, n: Column) -> Column:
    return m - n > SURE * F.sqrt(m + n)


def turned(way: str) -> str:
    """The reverse of ``wrong>right``, with kindred encodings as one."""
    wrong, right = (KIN.get(e, e) for e in way.split(">"))
    return f"{right}>{wrong}"


def runs(documents: DataFrame, identity: str, text: str) -> DataFrame:
    """``identity, run``: each document's distinct :data:`RUN` matches; digits and dots give lone symbols their context."""
    return documents.where(F.col(text).isNotNull()).select(identity, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0)))).alias("run"))


def twin_key(run: Column) -> Column:
    """The run without its non-ASCII characters; where fewer than two letters stay, the pattern in which its characters recur.

    The second form is the same for two runs of which one is a character-by-character replacement of the other.
    """
    bare = F.regexp_replace(F.lower(run), r"[^\x00-\x7F]+", "")
    signs = F.split(run, "")
    pattern = F.array_join(F.transform(signs, lambda c: F.array_position(signs, c).cast("string")), ",")
    return F.when(F.length(bare) >= 2, bare).when(F.length(run) >= 5, F.concat(F.lit("#"), pattern))


def decoded() -> Callable[[str], dict[str, list[str]]]:
    """A function of a piece: everything that one of the decodings, undone once to ``DEPTH`` times, makes of it, with the decodings ``wrong>right`` that do."""
    undo, ways = undoing(), [(w, r) for w in ENCODINGS for r in ENCODINGS if w != r]

    def images(piece: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for wrong, right in ways:
            now, way = piece, f"{wrong}>{right}"
            for _ in range(DEPTH):
                now = undo(now, wrong, right)
                if now is None:
                    break
                fits = out.setdefault(now, [])
                if not fits or fits[-1] != way:
                    fits.append(way)
        return out

    return images


def images(pieces: DataFrame) -> DataFrame:
    """``garbled, clean``: for each ``piece`` whatever without ASCII characters decodings make of it."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = decoded()
        for batch in batches:
            for piece in batch["piece"]:
                clean = [c for c in found(piece) if c != piece and min(c) > "\x7f"]
                yield pd.DataFrame({"garbled": [piece] * len(clean), "clean": clean})

    return pieces.select("piece").repartition(pieces.sparkSession.sparkContext.defaultParallelism).mapInPandas(make, "garbled string, clean string")


def held_pieces(counts: DataFrame) -> DataFrame:
    """``key, parts, place, piece, n, k``: the non-ASCII pieces of runs by twin key, ASCII parts and place, with the documents of their most frequent run, where
    a place has different ones (in any case), ``k`` rows in all."""
    parts = F.when(F.col("key").startswith("#"), F.array().cast("array<string>")).otherwise(F.split(F.lower("run"), r"[^\x00-\x7F]+"))
    keyed = counts.withColumn("key", twin_key(F.col("run"))).where("key IS NOT NULL").withColumn("parts", F.array_join(parts, "|"))
    each = keyed.select("key", "parts", "n", F.posexplode(F.regexp_extract_all(F.col("run"), F.lit(r"[^\x00-\x7F]+"), F.lit(0))).alias("place", "piece"))
    pieces = each.groupBy("key", "parts", "place", "piece").agg(F.max("n").alias("n"))
    sizes = pieces.groupBy("key", "parts", "place").agg(F.count(F.lit(1)).alias("k"), F.min(F.lower("piece")).alias("_least"), F.max(F.lower("piece")).alias("_most"))
    return pieces.join(sizes.where("_least < _most").drop("_least", "_most"), ["key", "parts", "place"])


def mappings(counts: DataFrame, least: int = MAPPINGS) -> DataFrame:
    """``garbled, clean, words, m, n, strong, certain, best, letter``: non-ASCII pieces that stand for each other in twins, in how many words they do, and the
    documents of the clean and of the garbled words.

    ``counts`` has each ``run`` with ``n``, its number of documents in any case. Every run is aligned with all others of its twin key and ASCII
    parts: what stands in one place is a pair, of which both pieces are tried as the garbled one. ``strong`` are mappings with a word whose
    twin is ``RATIO`` times as frequent, and the ``certain`` ones, of which all words together show which piece is the clean one. ``best`` are the words in which
    no other letter has more documents in the place of several characters (others may be garbled too), ``letter`` whether these together show the clean piece.

    Given whole are all pairs of which a decoding makes the one out of the other, and all of several characters with ``least`` keys or more and a letter;
    nothing reads others. In places of more than ``CROWD`` pieces the first meet where an image of one piece equals another, the second are
    such pieces with the letters of the place, so no crowd is paired as a whole.
    """
    where = ["key", "parts", "place"]
    held = written(held_pieces(counts), "pieces")
    few, many = held.where(F.col("k") <= CROWD), held.where(F.col("k") > CROWD)
    garbled = lambda df: df.select(*where, F.col("piece").alias("garbled"), "n")
    clean = lambda df: df.select(*where, F.col("piece").alias("clean"), F.col("n").alias("m"))
    near = garbled(few).join(clean(few), where)
    crowd = many.select("piece").distinct()
    made = images(crowd).join(crowd.withColumnRenamed("piece", "clean"), "clean", "left_semi")
    told = garbled(many).join(made, "garbled").join(clean(many), [*where, "clean"])
    often = many.join(held.groupBy("piece").agg(F.countDistinct("key").alias("_keys")).where(F.col("_keys") >= least), "piece", "left_semi")
    apart = garbled(often.where(F.length("piece").between(2, PIECE))).join(clean(many.where(F.col("piece").rlike(r"^\p{L}$"))), where)
    pairs = near.unionByName(told).unionByName(apart).where("lower(garbled) != lower(clean)")
    words = pairs.groupBy("garbled", "clean", "key", "parts").agg(F.max("m").alias("m"), F.max("n").alias("n"))
    letter = F.when(for_letter(), F.col("m"))
    most = words.where(for_letter()).groupBy("garbled", "key", "parts").agg(F.max("m").alias("most"))
    words = words.join(most, ["garbled", "key", "parts"], "left").withColumn("_best", F.coalesce(letter == F.col("most"), F.lit(False)))
    clear = F.max(F.col("m") >= F.col("n") * RATIO)
    best = lambda c: F.when(F.col("_best"), F.col(c))
    sums = words.groupBy("garbled", "clean").agg(
        F.countDistinct("key").alias("words"), F.sum("m").alias("m"), F.sum("n").alias("n"), clear.alias("clear"),
        F.countDistinct(best("key")).alias("best"), F.coalesce(sure(F.sum(best("m")), F.sum(best("n"))), F.lit(False)).alias("letter"),
    )
    certain = sure(F.col("m"), F.col("n"))
    return sums.select("garbled", "clean", "words", "m", "n", (F.col("clear") | certain).alias("strong"), certain.alias("certain"), "best", "letter")


def for_letter() -> Column:
    """Whether a mapping is of several characters in the place of one letter that isn't among them."""
    return F.length("garbled").between(2, PIECE) & F.col("clean").rlike(r"^\p{L}$") & ~F.contains(F.lower("garbled"), F.lower("clean"))


def explained(pairs: DataFrame) -> DataFrame:
    """``fits, strong, over, certain, m, n``: for each set of decodings ``(wrong>right)`` that turn the garbled piece of a mapping into its clean
    one, how many mappings have it (strong ones, those with more clean documents, certain ones) and their documents. Mappings that no decoding explains have
    an empty set. Written, as it is read again and again."""
    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, before, made = decoded(), None, {}
        for batch in batches:
            out = []
            for garbled, clean in zip(batch["garbled"], batch["clean"], strict=True):
                if garbled != before:
                    before, made = garbled, found(garbled)
                out.append(made.get(clean, []))
            yield batch[["m", "n", "strong", "certain"]].assign(fits=out)

    spread = pairs.select("garbled", "clean", "m", "n", "strong", "certain").repartition(pairs.sparkSession.sparkContext.defaultParallelism, "garbled").sortWithinPartitions("garbled")  # few bytes, much work
    fitting = spread.mapInPandas(explain, "m bigint, n bigint, strong boolean, certain boolean, fits array<string>").where(F.size("fits") > 0).groupBy("fits")
    over = F.count_if((F.col("m") > F.col("n")) | F.col("strong"))
    return written(fitting.agg(F.count_if("strong").alias("strong"), over.alias("over"), F.count_if("certain").alias("certain"), F.sum("m").alias("m"), F.sum("n").alias("n")), "explained")


def transformations(pairs: DataFrame, least: int = MAPPINGS) -> list[tuple[str, str, bool]]:
    """The ``(wrong, right, certain)`` decodings that the aligned mappings show, most telling first, and whether all its mappings together do so.

    Every mapping names the decodings that turn its garbled piece into its clean one. Chosen is again and again the
    decoding that explains most strong mappings not yet explained, down to ``least``; where all its mappings together show which
    side is clean, the weak ones count too. Where a decoding has garbled many documents, rare
    words show its reverse by chance: of mappings that a chosen decoding explains backwards only the certain ones count then. Votes are
    counted by Spark, once for each choice; what reaches the driver is one row of sums for each decoding of the fixed list.
    """
    left, chosen, skewed = explained(pairs), [], set()
    ways = [f"{w}>{r}" for w in ENCODINGS for r in ENCODINGS if w != r]
    sums = left.select(F.explode("fits").alias("way"), "m", "n").groupBy("way").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).collect()
    together = {r["way"] for r in sums if r["m"] - r["n"] > SURE * (r["m"] + r["n"]) ** 0.5}
    while True:
        backwards = [w for w in ways if turned(w) in skewed]
        doubtful = F.arrays_overlap("fits", F.array(*map(F.lit, backwards))) if backwards else F.lit(False)
        each = left.withColumn("_doubtful", doubtful).select(F.explode("fits").alias("way"), "*")
        vote = F.when(F.col("_doubtful"), F.col("certain")).when(F.col("way").isin(list(together)), F.col("over")).otherwise(F.col("strong"))
        votes = {r["way"]: r for r in each.groupBy("way").agg(F.sum(vote).alias("votes"), F.sum("over").alias("over"), F.sum("m").alias("m"), F.sum("n").alias("n")).collect()}
        best = max(votes, key=lambda w: (votes[w]["votes"], -ENCODINGS.index(w.split(">")[0]), -ENCODINGS.index(w.split(">")[1])), default=None)
        if best is None or votes[best]["votes"] < least:
            return chosen
        mine = votes[best]
        chosen.append((*best.split(">"), best in together and mine["over"] >= least))
        if mine["n"] > SKEWED * (mine["m"] + mine["n"]):
            skewed.add(turned(turned(best)))
        left = left.where(~F.array_contains("fits", best))


def learned_pieces(pairs: DataFrame, least: int = MAPPINGS) -> DataFrame:
    """``piece, letter``: aligned mappings that stand by themselves, whether a known decoding explains them or not: two or more characters in the place of one
    letter that isn't among them, in ``least`` twins or more in which no other letter is more frequent, whose documents together tell which side is clean. (Of one sign for another, twins can't tell a wrong
    decoding from a misspelling.) A piece that stands for several letters is none."""
    apart = for_letter() & (F.col("best") >= least) & F.col("letter")
    ones = pairs.where(apart).groupBy(F.col("garbled").alias("piece")).agg(F.countDistinct(F.lower("clean")).alias("_ways"), F.lower(F.first("clean")).alias("letter"))
    return ones.where("_ways = 1").select("piece", "letter")


def by_pieces(counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``run, n, clean``: each run that holds learned pieces, the longest put right first (in upper case where the run is)."""
    signs = F.regexp_extract_all(F.col("run"), F.lit(r"[^\x00-\x7F]{2,}"), F.lit(0))
    cuts = lambda p, k: F.when(F.length(p) >= k, F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substr(p, i, k))).otherwise(F.array().cast("array<string>"))
    parts = F.flatten(F.transform(signs, lambda p: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(PIECE)), lambda k: cuts(p, k)))))
    held = counts.select("run", "n", F.explode(F.array_distinct(parts)).alias("piece")).join(pieces, "piece")
    held = held.groupBy("run").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.length("piece")).alias("k"), "piece", "letter"))).alias("_put"))
    clean = F.aggregate("_put", F.col("run"), lambda s, p: F.replace(s, p["piece"], p["letter"]))
    return held.select("run", "n", F.when(F.col("run").rlike("[A-Z]") & ~F.col("run").rlike("[a-z]"), F.upper(clean)).otherwise(clean).alias("clean"))


def garbled_runs(counts: DataFrame, learned: list[tuple[str, str, bool]], pieces: DataFrame | None = None) -> DataFrame:
    """``run, clean``: each garbled run with what it was, null where that can't be told.

    Decodings generalise the aligned pieces to those that no twin shows; where no decoding tells what a run was, the aligned ``pieces`` themselves
    are put right, if the corpus has the result in as many documents as chance allows.

    The learned decodings are undone on every run, once to ``DEPTH`` times. The result counts where the corpus has it (in any case) in so
    many documents that it outweighs the run, and it is no single character for another one. Where the decoding is learned in one direction only,
    its mappings together have told which side is clean, and the result, if it isn't garbled itself, need only be there in as many documents as chance allows. UTF-8
    read as a one-byte encoding (learned or not) needs no count where it shows by itself, see :func:`strict`. For names, which may stand nowhere
    else, the run's shape (its ASCII parts alike) is counted instead: between marks, and where bytes turn out as valid UTF-8. Runs with a replacement
    character are garbled too; their twin of the same ASCII letters is what they were, if there is one only.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        undo, ways = undoing(), {f"{w}>{r}" for w, r, _ in learned}
        backwards = {turned(w) for w in ways}
        tried = [(w, r, certain and turned(turned(f"{w}>{r}")) not in backwards) for w, r, certain in learned]
        tried += [(w, "utf-8", False) for w in ENCODINGS[1:] if f"{w}>utf-8" not in ways]
        for batch in batches:
            out = []
            for run, n in zip(batch["run"], batch["n"], strict=True):
                for place, (wrong, right, alone) in enumerate(tried):
                    now = run
                    for _ in range(DEPTH):
                        now = undo(now, wrong, right)
                        if now is None or now == run:
                            break
                        if now.lower() != run.lower() and (len(now) > 1 or len(run) > 1 or "\x80" <= run <= "\x9f"):
                            plain = right == "utf-8" and strict(run, now)
                            if plain or place < len(learned):
                                out.append((run, n, now, now.lower(), right == "utf-8", alone, plain, place < len(learned), now in (now.lower(), now.upper(), now.capitalize()), -place))
            yield pd.DataFrame(out, columns=["run", "n", "clean", "folded", "wide", "alone", "plain", "learned", "usual", "place"])

    tried = counts.select("run", "n").mapInPandas(apply, "run string, n bigint, clean string, folded string, wide boolean, alone boolean, plain boolean, learned boolean, usual boolean, place int")
    folded = counts.groupBy(F.lower("run").alias("folded")).agg(F.max("n").alias("m"))
    m, n = F.col("m"), F.col("n")
    mixed = lambda c: F.col(c).rlike("[A-Za-z]") & F.col(c).rlike("[\\x{370}-\\x{4FF}]")
    held = tried.join(folded, "folded", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    known = held.where(F.col("plain") | (F.col("learned") & outweighs(m, n)))
    known = known.unionByName(held.where(F.col("alone") & ~mixed("clean") & (m > 0) & (n <= m + SLACK * F.sqrt(m + n))).join(known.select(F.lower("run").alias("folded")).distinct(), "folded", "left_anti"))
    known = known.select("run", "plain", "m", "usual", "place", "clean")
    shape = lambda c: F.regexp_replace(F.lower(c), "[a-z0-9.]+", "a")
    shapes = counts.groupBy(shape("run").alias("shape")).agg(F.sum("n").alias("m"))
    marked = tried.where("learned").where(F.col("wide") | (F.col("run").rlike(MARKED) & F.col("clean").rlike(MARKED))).select("run", "plain", "usual", "place", "clean", shape("run").alias("was"), shape("clean").alias("shape"))
    marked = marked.join(shapes, "shape").join(shapes.select(F.col("shape").alias("was"), F.col("m").alias("k")), "was").where(outweighs(m, F.col("k"))).select("run", "plain", "m", "usual", "place", "clean")
    known = known.unionByName(marked).groupBy("run").agg(F.max(F.struct("plain", (~mixed("clean")).alias("pure"), "m", "usual", "place", "clean")).alias("best")).select("run", "best.clean")
    if pieces is not None:
        put = by_pieces(counts.join(known, "run", "left_anti"), pieces).withColumn("folded", F.lower("clean")).join(folded, "folded").where((m > 0) & (n <= m + SLACK * F.sqrt(m + n)) & ~mixed("clean"))
        known = known.unionByName(put.select("run", "clean"))
    further = known.select(F.col("run").alias("clean"), F.col("clean").alias("next"))  # a result may be garbled in another way
    known = known.join(further, "clean", "left").select("run", F.coalesce(F.when(F.col("next") != F.col("run"), F.col("next")), "clean").alias("clean"))
    broken = counts.where(F.col("run").rlike("[�\u0080-\u009F]"))
    lost = broken.join(known, "run", "left_anti").withColumn("key", twin_key(F.col("run"))).select("run", "key")
    whole = counts.join(known, "run", "left_anti").where(~F.col("run").rlike("[�\u0080-\u009F]") & ~mixed("run")).withColumn("key", twin_key(F.col("run"))).where("key IS NOT NULL AND NOT startswith(key, '#')")
    twins = whole.groupBy("key").agg(F.countDistinct(F.lower("run")).alias("ways"), F.max_by("run", "n").alias("twin"))
    guessed = lost.join(twins, "key", "left").select("run", F.when(F.col("ways") == 1, F.col("twin")).alias("clean"))
    return known.unionByName(guessed)


def learn(documents: DataFrame, identity: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(seen, garbled)``: the runs of each document as a written table, and the garbled ones among them."""
    seen = written(runs(documents, identity, text), "runs")
    cased = seen.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    counts = written(cased.withColumn("n", F.sum("n").over(Window.partitionBy(F.lower("run")))), "run-counts")
    pairs = written(mappings(counts), "mappings")
    return seen, garbled_runs(counts, transformations(pairs), learned_pieces(pairs))


def restore(documents: DataFrame, identity: str, text: str) -> DataFrame:
    """``identity, restored, whole``: the documents with garbled parts, their text with each known run put right, and whether
    all garbled runs were known.

    Only the concerned documents' own replacements meet their text. Rows with null texts or identities are left out.
    """
    seen, garbled = learn(documents, identity, text)
    mine = seen.join(garbled, "run").groupBy(identity).agg(F.map_from_entries(F.collect_set(F.struct("run", F.coalesce("clean", "run")))).alias("fixes"), F.every(F.col("clean").isNotNull()).alias("whole"))
    parts = F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))
    between = F.split(F.col(text), RUN, -1)
    put = F.transform(F.arrays_zip(between.alias("gap"), F.concat(parts, F.array(F.lit(""))).alias("run")), lambda p: F.concat(p["gap"], F.coalesce(F.element_at("fixes", p["run"]), p["run"])))
    return documents.select(identity, text).join(mine, identity).select(identity, F.array_join(put, "").alias("restored"), "whole")
