"""Per-document text quality statistics (problem 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.partitions import spread
from winnow.llm.wikitext import COMMENT, TAG, WORD, fold

#: Statistics with a distribution per language.
STATISTICS = ["word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "prose_words"]
OTHER = "other"
LINE = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
MARKED = re.compile(r"[ \t​﻿]*(?:[*#;:|!=]|\{\||<t[rdh]\b|<table|</t|-{4})")
LINKS = re.compile(r"(?:\W|_)*(?:\[\[[^\[\]]*\]\](?:\W|_)*)+")
ENDS = tuple(".!?…。！？\"”»'’)")
#: Template braces; a template's values are looked at one by one.
BRACES = re.compile(r"\{\{[^{}]*\}\}")
LABEL = re.compile(r"^[^|={}\[\]<>]{0,60}=")


#: A parameter of a template, with or without a default.
PLACEHOLDER = re.compile(r"\{\{\{[^{}]*\}\}\}")
#: Words in small letters that could be spoken: a vowel, and no long run of either kind.
VOWELS = "aeiouyäöüáéíóúàèìòùâêîôûëïœæåø"
SPOKEN = re.compile(rf"(?=.*[{VOWELS}])(?!.*[^{VOWELS}]{{5}})(?!.*[{VOWELS}]{{4}})(?!.*(.)\1\1)(?!.*(..)\2\2)[^\W\d_]+")


def _words(text: str) -> tuple[list[str], list[str]]:
    """Folded words, and the words as written."""
    found, raw = WORD.findall(fold(text)), WORD.findall(text)
    return found, raw if len(raw) == len(found) else found


def _lettered(line: str) -> bool:
    """Whether at least half of the visible characters belong to words."""
    visible = len("".join(line.split()))
    return 2 * sum(map(len, WORD.findall(line))) >= visible


def spoken(raw: list[str]) -> bool:
    """Whether many words begin with a small letter and nearly all of these could be spoken."""
    small = [w for w in raw if w[0].islower() and len(w) > 1]
    if len(small) < 0.4 * len(raw):
        return False
    return sum(SPOKEN.fullmatch(w) is not None for w in small) >= 0.93 * len(small)


class Quality:
    """Statistics of one text after another."""

    def __init__(self, common: dict[str, set[str]]):
        self.common = common
        self.any = set().union(*common.values()) if common else set()

    def running(self, found: list[str], raw: list[str]) -> bool:
        """Whether a piece of text, given by its folded words and the words as written, reads like sentences.

        Function words make up a good part of sentences in any language, and several different ones
        take turns; names, numbers, keyboard noise and repeated words lack one or the other.  Sentences
        with few function words are told by small words that could be spoken.
        """
        n = len(found)
        if n < 3:
            return False
        used = [w for w in found if w in self.any and not w.isdigit()]
        kinds = len(set(used))
        varied = len(set(found)) >= 0.3 * min(n, 60)
        if n < 10:
            plain = len(used) >= 0.2 * n and (kinds >= 2 or n <= 5)
        else:
            plain = len(used) >= 0.1 * n and kinds >= min(8, 2 + n // 20) and varied
        return plain or (n >= 6 and kinds >= 1 and varied and spoken(raw))

    def prose(self, text: str) -> int:
        """Words of the text that are part of running sentences."""
        total = 0
        if "<" in text:
            text = TAG.sub(self._tag, COMMENT.sub(" ", text))
        if "{{" in text:
            text = PLACEHOLDER.sub(" ", text)
            pieces: list[str] = []
            for _ in range(12):
                text, n = BRACES.subn(lambda m: self._template(m[0], pieces), text)
                if not n:
                    break
            for value in pieces:
                found, raw = _words(value)
                if self.running(found, raw):
                    total += len(found)
        block: list[str] = []
        for line in [*LINE.split(text), ""]:
            if line.strip() and not MARKED.match(line) and not (line.lstrip()[:2] == "[[" and LINKS.fullmatch(line)):
                block.append(line)
            elif block:
                total += self._block(block)
                block = []
        return total

    @staticmethod
    def _tag(tag: re.Match) -> str:
        """Cells and rows of a table stay as marks of lines; other tags separate nothing."""
        return "\n| " if tag[0][1:3].lower() in ("tr", "td", "th", "ta") else " "

    @staticmethod
    def _template(template: str, pieces: list[str]) -> str:
        """The values of a template that may hold sentences go to pieces, short ones stay in the line."""
        inner = template[2:-2]
        head, *values = inner.split("|")
        values = [LABEL.sub("", v) for v in values]
        long = [v for v in values if v.count(" ") >= 6 and ("\n" not in v.strip() or v.count("\n") < v.count(" ") / 4)]
        pieces.extend(long)
        short = [v for v in values if v not in long]
        return " " + " ".join(short) + " " if len(head) < 40 and len(values) <= 3 and not long and "\n" not in inner else " "

    def _block(self, lines: list[str]) -> int:
        """Words in the sentences of consecutive lines; each line is judged with its neighbours."""
        both = [_words(x) if _lettered(x) else ([], []) for x in lines]
        total = 0
        for k, (own, raw) in enumerate(both):
            if len(own) >= 24 or len(both) == 1:
                good = self.running(own, raw)
            else:
                before, after = both[k - 1] if k else ([], []), both[k + 1] if k + 1 < len(both) else ([], [])
                alone = len(own) >= 6 and not any(w in self.any for w in own) and not spoken(raw)
                good = not alone and self.running(before[0][-12:] + own + after[0][:12], before[1][-12:] + raw + after[1][:12])
            total += len(own) if good else 0
        return total

    def of(self, text: str | None, lang: str) -> tuple:
        """The statistics in the order of STATISTICS; shares of nothing are null."""
        if not text or text.isspace():
            return (0, None, None, None, None, None)
        found = WORD.findall(fold(text))
        n = len(found)
        letters = sum(map(len, found))
        blanks = len(text) - len("".join(text.split()))
        visible = len(text) - blanks
        lines = [x.rstrip() for x in LINE.split(text)]
        lines = [x for x in lines if x]
        own = self.common.get(lang, self.any)
        return (
            n,
            letters / n if n else None,
            max(0, visible - letters) / visible if visible else None,
            sum(x.endswith(ENDS) for x in lines) / len(lines) if lines else None,
            sum(w in own for w in found) / n if n else None,
            min(1.0, self.prose(text) / n) if n else 0.0,
        )


def language(lang: Column, known: list[str]) -> Column:
    """The language without case, region and blanks; ``other`` for null and for those without common words."""
    short = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)", 1)
    return F.when(short.isin(known), short).otherwise(F.lit(OTHER))


def statistics(df: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words, prose_words).

    Words are the longest runs of letters or digits; mean_word_length is in characters; symbol_ratio is
    the share of visible characters outside words; punctuated_lines the share of lines, blank ones
    apart, that end in punctuation; common_words the share of words among the frequent ones of the
    language, or of any language where it is unknown; prose_words the share of words in running
    sentences, as opposed to headings, lists, tables, templates, redirects, links and noise.

    Defined cases: a null, empty or blank text has a word_count of 0 and null shares; a text without
    words has null shares of words and a prose_words of 0; texts are read whole; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.

    ``common`` (lang, word) holds a few hundred frequent words and is collected.
    """
    if common.count() > 200_000:
        raise ValueError("a table of common words has at most 200,000 rows")
    table: dict[str, set[str]] = {}
    for tongue, word in common.select("lang", "word").where("lang is not null and word is not null").collect():
        table.setdefault(tongue.lower(), set()).add(fold(word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality = Quality(table)
        for batch in batches:
            rows = [quality.of(t, g) for t, g in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(STATISTICS)
            kinds = [pa.int64(), *[pa.float64()] * (len(STATISTICS) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[key, "language", *STATISTICS],
            )

    kind = df.schema[key].dataType.simpleString()
    doubles = ", ".join(f"{s} double" for s in STATISTICS[1:])
    few = df.select(key, language(F.col(lang), sorted(table)).alias("language"), text)
    return spread(few).mapInArrow(run, f"`{key}` {kind}, language string, word_count long, {doubles}")


def sketches(stats: DataFrame) -> DataFrame:
    """One mergeable quantile sketch of each statistic for each language: (language, sketch_...)."""
    return stats.groupBy("language").agg(
        *(F.kll_sketch_agg_double(F.col(s).cast("double")).alias(f"sketch_{s}") for s in STATISTICS)
    )


#: Quantiles read from a sketch.
GRID = [k / 100 for k in range(101)]


def quantiles(by: DataFrame, of: list[str]) -> DataFrame:
    """(language, grid_...): the quantiles of GRID of the given statistics, from their sketches; null where
    a sketch is of nulls only."""
    grid = F.array(*map(F.lit, GRID))

    def read(sketch: Column) -> Column:
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, grid))

    return by.select("language", *(read(F.col(f"sketch_{s}")).alias(f"grid_{s}") for s in of))


def _percentile(value: Column, grid: Column) -> Column:
    """Share of the grid's quantiles below the value."""
    return F.size(F.filter(grid, lambda q: q < value)) / F.lit(float(len(GRID)))


def standing(stats: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """The statistics with rank_... (percentile among the language's documents, as a share) and z_...
    (distance from the median in robust standard deviations, from the quartiles).

    ``by`` is the table of :func:`sketches`, by default that of the same documents.  It has a row for each
    language of the table of common words and one for the others, so it is broadcast.
    """
    by = quantiles(sketches(stats) if by is None else by, STATISTICS)
    both = stats.join(F.broadcast(by), "language", "left")
    out = [F.col(c) for c in stats.columns]
    for s in STATISTICS:
        grid, value = F.col(f"grid_{s}"), F.col(s).cast("double")
        low, middle, high = (F.get(grid, F.lit(k)) for k in (25, 50, 75))
        known = value.isNotNull() & grid.isNotNull()
        out.append(F.when(known, _percentile(value, grid)).alias(f"rank_{s}"))
        spread = (high - low) / 1.349
        out.append(F.when(known & (spread > 0), (value - middle) / spread).alias(f"z_{s}"))
    return both.select(*out)


#: Share of a statistic's variance that lies between its two modes if it has two; an even distribution has 0.75, a normal
#: one 0.64.
TWO_MODES = 0.8


def valley(quantiles_: list[float]) -> tuple[float, float]:
    """(cut, share): the value that parts the quantiles of a distribution into the two groups that differ most, and
    the share of the variance between them.  Points of a value that occurs often stay together."""
    q = np.asarray(quantiles_, float)
    total = q.var() * len(q)
    steps = np.flatnonzero(q[1:] > q[:-1]) + 1
    if not len(steps) or total <= 0:
        return float("-inf"), 0.0
    sums = np.cumsum(q)
    below, above = sums[steps - 1] / steps, (sums[-1] - sums[steps - 1]) / (len(q) - steps)
    between = steps * (len(q) - steps) / len(q) * (below - above) ** 2
    best = steps[int(np.argmax(between))]
    return float((q[best - 1] + q[best]) / 2), float(between.max() / total)


def tail_cuts(by: DataFrame, statistic: str) -> dict[str, float]:
    """The value below which each language's documents are its lower tail, from the sketches.

    Where a language's sketch has two modes, the cut is the valley between them.  Where it has one (few documents, or
    all of one kind), it is the valley of the merged sketches of all languages; without two modes there,
    nothing is a tail.  There is one row for each language of the table of common words.
    """
    name = f"sketch_{statistic}"
    grid = F.array(*map(F.lit, GRID))
    whole = by.agg(F.kll_merge_agg_double(name).alias(name)).select(F.lit(None).cast("string").alias("language"), name)
    both = by.select("language", name).unionAll(whole)
    known = both.where(F.kll_sketch_get_n_double(name) > 0)
    rows = known.select("language", F.kll_sketch_get_quantile_double(name, grid).alias("grid")).collect()
    cuts = {r["language"]: valley(r["grid"]) for r in rows}
    pooled = cuts.pop(None, (float("-inf"), 0.0))
    pooled_cut = pooled[0] if pooled[1] >= TWO_MODES else float("-inf")
    return {lang: cut if share >= TWO_MODES else pooled_cut for lang, (cut, share) in cuts.items()}


def lower_tail(stats: DataFrame, statistic: str, by: DataFrame | None = None) -> DataFrame:
    """The documents in the lower tail of a statistic in their language: those below the cut that the distribution
    of the statistic gives (:func:`tail_cuts`), with it as column ``tail_cut``.  Documents without a value are in
    no tail."""
    cuts = tail_cuts(sketches(stats.select("language", *STATISTICS)) if by is None else by, statistic)
    if not cuts:
        return stats.withColumn("tail_cut", F.lit(None).cast("double")).where(F.lit(False))
    table = F.create_map(*(F.lit(v) for pair in sorted(cuts.items()) for v in pair))
    both = stats.withColumn("tail_cut", F.element_at(table, F.col("language")))
    return both.where(F.col(statistic).cast("double") < F.col("tail_cut"))
