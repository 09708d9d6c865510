"""License scans: short notices found exactly and with a bounded number of edits.

Texts are lower-cased (A-Z) and read as words with single blanks between them.  A notice with at most k edits is cut into k + 1
pieces: an occurrence with that many edits holds one piece unchanged (pigeonhole), so one pass of an Aho-Corasick automaton over all pieces of
all notices finds the places that can hold any of them.  Around such places the regex library matches the notice with at most k insertions,
deletions and substitutions, from the start of a word to the end of one, and gives the span and its edits.  Phrases are counted
where their words stand consecutively; that is exact and does not depend on the search with edits.

Notices are few and fixed, so the automaton is built in every task; nothing is shuffled.  The work grows with the text, and with the
seeds that it holds: windows of seeds that overlap are matched as one.

Defined results: null, empty and wordless texts have no words, no spans and score 0; repeated rows get equal results; of overlapping
spans of one notice the leftmost stays; extra columns are ignored, or kept where ``keep`` names them; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are counted word by word, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices, their labels and the edits (of letters) that they may have.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("apache license version 2 0", "apache", 2),
    ("apache license", "apache", 1),
    ("the mit license", "mit", 1),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 2),
]
#: Bytes that are no word bytes become blanks; A-Z are lower-cased first.
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def normal(raw: bytes) -> str:
    """The words of a text with single blanks between them, and one at each end."""
    return f" {b' '.join(raw.lower().translate(_TO_WORDS).split()).decode(errors='replace')} "


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in ``edits`` + 1 pieces of near equal length, with their places."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """All notices at once."""

    def __init__(self, notices: list[tuple[str, str, int]] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.notices, self.phrases = notices, phrases
        self.patterns = [regex.compile(f"(?e)(?<= )(?:{regex.escape(n, special_only=True)}){{e<={k}}}(?= )") for n, _, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, _, k) in enumerate(notices):
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.seeds.add_word(piece, (len(piece), of))
        for phrase, label in phrases.items():
            self.seeds.add_word(f" {phrase} ", (0, [(label, phrase.count(" ") + 1)]))
        self.seeds.make_automaton()

    def windows(self, text: str) -> tuple[list[tuple[str, int]], dict[int, list[list[int]]]]:
        """Labels and places of phrases, and by notice the stretches of the text that can hold it."""
        exact, found = [], {}
        for end, (size, of) in self.seeds.iter(text):
            if not size:
                label, n = of[0]
                exact.append((label, end, n))
                continue
            for i, at in of:
                notice, _, k = self.notices[i]
                start = end + 1 - size - at
                a, z = max(0, start - k - 1), min(len(text), start + len(notice) + k + 1)
                mine = found.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(a, mine[-1][0]), max(z, mine[-1][1])
                else:
                    mine.append([a, z])
        return exact, found

    def spans(self, text: str, found: dict[int, list[list[int]]]) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the matches within the stretches."""
        out = []
        for i, stretches in found.items():
            least = len(self.notices[i][0]) - self.notices[i][2]
            for a, z in stretches:
                if z - a >= least:
                    out += [(m.start(), m.end(), i, sum(m.fuzzy_counts)) for m in self.patterns[i].finditer(text, a, z)]
        return sorted(set(out))

    def scan(self, raw: bytes | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        text = normal(raw) if raw else "  "
        n_words = 0 if len(text) < 3 else text.count(" ") - 1
        if not n_words:
            return 0, 0, None, None, "", "", 0.0, []
        exact, found = self.windows(text)
        spans = self.spans(text, found)
        if not exact and not spans:
            return n_words, 0, None, None, "", "", 0.0, []
        blank = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20)
        word = lambda at: int(np.searchsorted(blank, at))  # noqa: E731  # words that start before a place
        starts = [word(end) - n for _, end, n in exact]
        base = {label for label, _, _ in exact}
        also = base | {self.notices[i][1] for _, _, i, _ in spans}
        score = 1.0 if exact else max(1 - e / len(self.notices[i][0]) for _, _, i, e in spans)
        said = [f"{self.notices[i][1]}:{word(a) - 1}:{word(z)}:{e}" for a, z, i, e in spans]
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return n_words, len(exact), first, last, ",".join(sorted(base)), ",".join(sorted(also)), score, said


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, and ``keep``.

    ``spans`` are strings label:start:end:edits of notices with at most their edits, in words (end exclusive); the score is 1 where a phrase
    stands exactly, else the greatest share of a notice's letters that is unchanged, 0 without any.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search()
        for b in batches:
            cols = list(zip(*map(search.scan, b.column(1).cast(pa.binary()).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], *[b.column(2 + i) for i in range(len(keep))]], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans", *[f"__keep_{c}" for c in keep]]
    kind = lambda c: src.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('__id')}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<string>"
    schema += "".join(f", `__keep_{c}` {kind(f'__keep_{c}')}" for c in keep)
    return src.mapInArrow(run, schema).withColumnsRenamed({f"__keep_{c}": c for c in keep})
