"""Fuzzy search for short licence notices.

Texts and notices are brought to words of letters, digits and non-ASCII characters in lower case, joined by one space.
A notice that may have k edits is split into k + 1 pieces; by the pigeonhole principle any match holds one of them
unchanged, so exact searches for the pieces find every place worth looking at. There the regex library matches the
notice with at most k edits and tells where and how many. Whole phrases are found beside that by exact search.

Licences differ by a word or two, which edits must not touch: a notice names its telling words, which have to stand as
they are; the edits are those of what is before and after them. Where notices overlap, the one with the fewest edits
stays (of equals the longest), so a notice is not reported beside the variant that the text really holds.

All work on a document is done where the document is: no shuffle, and memory of one text and its words at a time; time
grows in proportion to the text.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exact phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices that are searched with edits, and their labels. They are written as normalised words; the words
# in brackets tell the licence from others and have to stand unchanged.
NOTICES = {
    "licensed under the [apache] license version 2 0": "apache",
    "spdx license identifier [apache 2 0]": "apache",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "spdx license identifier [bsd]": "bsd",
    "licensed under [cc by 4] 0": "cc-by",
    "licensed under [cc by nc 4] 0": "cc-by-nc",
    "licensed under [cc by nc nd 4] 0": "cc-by-nc-nd",
    "licensed under [cc by nc sa 4] 0": "cc-by-nc-sa",
    "licensed under [cc by nd 4] 0": "cc-by-nd",
    "licensed under [cc by sa 4] 0": "cc-by-sa",
    "licensed under the gnu [affero] general public license": "agpl",
    "licensed under the [gnu general] public license": "gpl",
    "spdx license identifier [gpl]": "gpl",
    "permission to use copy modify and or distribute this software": "isc",
    "spdx license identifier [isc]": "isc",
    "gnu [lesser general] public license": "lgpl",
    "spdx license identifier [lgpl]": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the [mit] license": "mit",
    "spdx license identifier [mit]": "mit",
    "subject to the terms of the [mozilla] public license": "mpl",
    "released under the [mpl] license": "mpl",
    "spdx license identifier [mpl 2 0]": "mpl",
    "free and unencumbered software released into the public domain": "unlicense",
    "spdx license identifier [unlicense]": "unlicense",
    "all rights reserved": "reserved",
}

#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12

_WORD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

SPAN = "label string, base boolean, start_word int, end_word int, edits int, score double, text string"


@dataclass(frozen=True)
class Notice:
    """text is the whole notice; head and tail, with spaces at their inner ends, surround the telling words, if it has any."""

    text: bytes
    label: str
    most: int
    pieces: tuple[tuple[int, bytes], ...]
    telling: bytes
    head: object
    tail: object


def compiled(notices: dict[str, str], chars_per_edit: int = CHARS_PER_EDIT) -> list[Notice]:
    out = []
    for words, label in notices.items():
        before, _, rest = words.encode().partition(b"[")
        telling, _, after = rest.partition(b"]")
        text = before + telling + after
        most = len(text) // chars_per_edit
        cuts = [round(i * len(text) / (most + 1)) for i in range(most + 2)]
        pieces = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:]))
        fuzzy = lambda x, how, end: regex.compile(rb"(?%s)(?:%s){e<=%d}%s" % (how, regex.escape(x), most, end))  # noqa: E731, B023
        # The spaces around the telling words belong to them.
        sides = (fuzzy(before.rstrip(), b"b", rb"\Z"), fuzzy(after.lstrip(), b"b", b"")) if telling else (fuzzy(text, b"e", b""), None)
        out.append(Notice(text, label, most, pieces, telling, *sides))
    return out


def normal(text: str) -> tuple[bytes, int]:
    """The words joined by single spaces with one more at either end, and their number."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD).split()
    return b" %s " % b" ".join(words), len(words)


def places(body: bytes, phrase: bytes) -> Iterator[int]:
    """Byte positions of the spaces before which the phrase's words stand consecutively, overlaps included."""
    sought, at = b" %s " % phrase, -1
    while (at := body.find(sought, at + 1)) >= 0:
        yield at


def regions(body: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged byte ranges that hold every match of the notice."""
    found = []
    for offset, piece in notice.pieces:
        at = -1
        while (at := body.find(piece, at + 1)) >= 0:
            begin = at - offset - notice.most
            found.append((max(0, begin), min(len(body), begin + len(notice.text) + 2 * notice.most)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def matches(body: bytes, notice: Notice) -> Iterator[tuple[int, int, int]]:
    """(begin, end, edits) of the notice's matches; white space at either end is left out."""
    for a, b in regions(body, notice):
        if not notice.telling:
            for m in notice.head.finditer(body, a, b):
                yield m.start(), m.end(), sum(m.fuzzy_counts)
            continue
        # A region's ends are those of matches, not of words: the space beside a telling word can be one byte further.
        for at in places(body[max(0, a - 1) : b + 1], notice.telling):
            at += max(0, a - 1)
            after = at + len(notice.telling) + 2
            reach = len(notice.text) + notice.most
            head = notice.head.search(body, max(0, at - reach), at)
            tail = notice.tail.match(body, after, min(len(body), after + reach)) if head else None
            if tail and sum(head.fuzzy_counts) + sum(tail.fuzzy_counts) <= notice.most:
                yield head.start(), tail.end(), sum(head.fuzzy_counts) + sum(tail.fuzzy_counts)


def best(spans: list[tuple]) -> list[tuple]:
    """Of spans (label, base, start, end, edits, ...) that overlap, the one with the fewest edits, then the longest, then the first."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[4], s[2] - s[3], s[2], s[0])):
        at = bisect.bisect_left(kept, s[3], key=lambda k: k[2])
        if at == 0 or kept[at - 1][3] <= s[2]:
            kept.insert(at, s)
    return kept


def scan(text: str, phrases: dict[str, str], notices: list[Notice]) -> tuple[int, list[tuple]]:
    """The number of words, and spans (label, base, start_word, end_word, edits, score, text)."""
    body, n = normal(text)
    base = [(label, at, phrase) for phrase, label in phrases.items() for at in places(body, phrase.encode())]
    fuzzy = []
    for notice in notices:
        for begin, end, edits in matches(body, notice):
            found = body[begin:end]
            if found.strip():
                fuzzy.append((notice, begin + len(found) - len(found.lstrip()), found.strip(), edits))
    if not base and not fuzzy:
        return n, []
    spaces = np.flatnonzero(np.frombuffer(body, np.uint8) == 0x20)
    word = lambda at: int(np.searchsorted(spaces, at))
    spans = [(label, True, word(at), word(at) + phrase.count(" ") + 1, 0, 1.0, phrase) for label, at, phrase in base]
    close = [(x.label, False, word(at) - 1, word(at) + found.count(b" "), edits, 1.0 - edits / len(x.text), found.decode("utf-8", "replace")) for x, at, found, edits in fuzzy]
    return n, spans + best(close)


def find_notices(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans: one row per document, whole texts.

    Spans of phrases have base true. Null and empty texts have no words and no spans; very long texts are searched
    whole; rows repeat as they do in the input, null ids stay null, other columns are not read, an empty table gives no
    rows. Notices that overlap leave one span, as the module says; phrases all stay.
    """
    phrases = PHRASES if phrases is None else phrases
    raw = NOTICES if notices is None else notices
    struct = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("edits", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
    names = [f.name for f in struct.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = compiled(raw, chars_per_edit)
        for b in batches:
            counts, spans = [], []
            for value in b.column(1):
                n, found = scan(value.as_py() or "", phrases, sought)
                counts.append(n)
                spans.append([dict(zip(names, x)) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(spans, struct)], ["doc_id", "n_words", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_words long, spans array<struct<{SPAN}>>")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: places and labels of the phrases, all labels, and the best score."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start_word"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.transform(F.filter("spans", lambda s: ~s["base"]), lambda s: F.struct(s["label"].alias("label"), s["start_word"].alias("start_word"), s["end_word"].alias("end_word"), s["edits"].alias("edits"))).alias("notices"),
    )
