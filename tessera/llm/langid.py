"""Language identification by cross-parsing entropy.

A suffix automaton of labelled running text is built for each language. A whole
text is parsed against each automaton from left to right into the longest runs
that occur in the labelled text, across words and spaces; the language in which
it takes the fewest phrases, normalised by log2 of the labelled text's length
and by the length of the parsed text (bits a character), wins. Texts are
lower-cased, and what is neither a letter nor a mark becomes one space.

Labelled text is a bounded sample: ``sample_rows`` texts a language, of any
length, which together hold ``train_chars`` characters, fewer where more than
ALL_CHARS / ``train_chars`` languages share a task's memory. A text longer than its
share of those gives ``PIECES`` pieces of running text spread over it. Every
label that has a text with a letter is learned. Prediction reads whole texts and
the text alone.

A text that is null, empty or without letters is ``und`` with score 0, as is
every text when there are no labels. Ties go to the label first by code point.
The score is 1 - phrases / characters in the best language: 0 where every
character is a phrase, towards 1 the longer the phrases. Copies are predicted
alike; other columns are kept, and those named like the outputs are replaced. An
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Workspace, release

UND = "und"
#: Pieces of a text that is longer than its share, the first from its start, the last from its end.
PIECES = 8
#: Label values up to which their sizes are sent to where the texts are read; more are joined.
BROADCAST_LABELS = 10_000
#: Characters of the labelled texts of all languages together; automata take some 300 bytes for each.
ALL_CHARS = 2_000_000
#: Characters at a text's start that say which language is parsed first; the result does not depend on it.
GLIMPSE = 100
#: Ends a piece of labelled text: no parsed text has it, so that no match crosses two pieces.
END = "\n"


def automaton(text: str) -> dict:
    """The root state of the suffix automaton of text; a state is the dictionary of its transitions."""
    states: list[dict] = [{}]
    length, link = [0], [-1]
    last = 0
    for ch in text:
        cur = len(states)
        states.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in states[p]:
            states[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = states[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(states)
                states.append(dict(states[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and states[p].get(ch) == q:
                    states[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    for s in states:
        for ch, to in s.items():
            s[ch] = states[to]
    return states[0]


def phrases(root: dict, text: str, most: float = math.inf, dead: dict = {}) -> int:  # noqa: B006  the dead state has no transitions
    """Phrases of the greedy parse, or more than most as soon as there are; a character that the labelled text lacks is a phrase of its own."""
    count, state = 0, dead
    for ch in text:
        to = state.get(ch)
        if to is None:
            count += 1
            if count > most:
                return count
            to = root.get(ch, dead)
        state = to
    return count


class Model:
    """texts: the labelled text of each language. A task builds its automata, and its worker is free of them afterwards."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.texts = [texts[lang] for lang in self.langs]
        self.bits = [math.log2(max(2, len(t))) for t in self.texts]

    def roots(self) -> list[dict]:
        return [automaton(t) for t in self.texts]

    def predict(self, roots: list[dict], text: str | None) -> tuple[str, float]:
        """text is normalised."""
        if not text or not self.langs:
            return UND, 0.0
        # the likely language first: the others' parses end where they have cost more than the least so far
        order = sorted(range(len(roots)), key=lambda k: phrases(roots[k], text[:GLIMPSE]) * self.bits[k])
        best, least, count = 0, math.inf, 0
        for k in order:
            n = phrases(roots[k], text, least / self.bits[k] * (1 + 1e-12))
            if n * self.bits[k] < least or n * self.bits[k] == least and k < best:
                best, least, count = k, n * self.bits[k], n
        return self.langs[best], 1.0 - count / len(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> Column:
    return F.col(text).rlike(r"\p{L}")


def normalised(text: str) -> Column:
    """The text as it is parsed; null without letters."""
    return F.when(has_letter(text), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")))


def excerpt(text: Column, chars: Column) -> Column:
    """Pieces of a text that together hold so many characters: the whole of a short one."""
    size = F.greatest(F.lit(1), F.floor(chars / PIECES)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.floor(k * (F.char_length(text) - size) / (PIECES - 1)).cast("int") + 1)
    return F.when(F.char_length(text) <= chars, F.array(text)).otherwise(F.transform(starts, lambda at: F.substring(text, at, size)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 150, train_chars: int = 48_000) -> Model:
    """A model of the languages of labelled rows.

    The sample is that of the smallest text hashes in each language: a share of
    the rows that holds about three times sample_rows is kept where it is read,
    copies of a text are merged before the shuffle, and only then are rows ranked.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & has_letter("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("__n"))
    near = (F.col("h") / F.lit(2.0**64) + 0.5) < F.least(F.lit(1.0), 3 * sample_rows / F.col("__n"))
    sizes = Workspace(labelled.sparkSession, "langid").save(sizes, "sizes")
    labels = sizes.count()
    few = labels <= BROADCAST_LABELS
    train_chars = min(train_chars, max(PIECES, ALL_CHARS // max(1, labels)))
    rows = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(near)
    # no row's share is less than train_chars / sample_rows, so what a text may give is cut to train_chars before the shuffle
    rows = rows.withColumn("pieces", excerpt(normalised("text"), F.lit(train_chars))).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    order = Window.partitionBy("lang").orderBy("h", "pieces")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_rows)
    rows = rows.withColumn("share", F.floor(train_chars / F.count("*").over(Window.partitionBy("lang"))))
    size = F.greatest(F.lit(1), F.floor(F.col("share") / PIECES)).cast("int")
    cut = F.when(F.size("pieces") > 1, F.transform("pieces", lambda p: F.substring(p, F.lit(1), size))).otherwise(excerpt(F.element_at("pieces", 1), F.col("share")))
    rows = rows.withColumn("pieces", cut)
    texts: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "r").select("lang", "pieces").toLocalIterator():  # train_chars a language, and as many ends of pieces at most
        texts.setdefault(r.lang, []).extend(r.pieces)
    return Model({k: END + END.join(v) + END for k, v in texts.items()})


def predict(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and score of every row; no shuffle. The model is bounded by train_chars a language."""

    @arrow_udf("struct<lang string, score double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        roots = model.roots()
        for a in batches:
            found = [model.predict(roots, x.as_py()) for x in a]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])
        del roots
        release()

    out = df.withColumn("__judged", judge(normalised(text)))
    return out.withColumn(lang, F.col("__judged.lang")).withColumn(score, F.col("__judged.score")).drop("__judged")
