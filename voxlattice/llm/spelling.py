"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

For each place of a word the polynomial hashes of what stands before it and behind it make one integer: the key of the word
without that code point. Two words of one length are near if they share the key of one place; a word and a longer one are
near if its whole key is one of the longer one's. Keys are made by numpy for a batch of words, dealt out by Spark and sorted
there; only rows whose key another row has get their words back and are compared as strings. What a word has near is summed
up in its groups, each row against the best and second best of its group, so no pairs are made.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written
from .textkernel import MIX_1, column_bytes, cut_out, mix, powers, prefix_sums, runs_of, segment_hash, slices, strings

SLICE = 4 << 20
#: crc32 of an id and of words up to so many bytes are joined by table, longer ones one by one.
_JOINED = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.isin(np.arange(256), list(range(ord("a"), ord("z") + 1)))
#: The lead byte of U+00C0 to U+00FF in UTF-8, and of nothing else.
_LATIN = 0xC3
# The reflected polynomial of crc32.
_POLYNOMIAL = 0xEDB88320

#: Place of a key that is the whole word.
_WHOLE = -1


def _zero_byte() -> np.ndarray:
    """What a zero byte makes of the low byte of a crc32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), t >> np.uint32(1))
    return t


def joint_crc(prefixes: list[bytes], words: list[bytes], prefix_of: np.ndarray, word_of: np.ndarray) -> np.ndarray:
    """crc32 of prefixes[prefix_of] + words[word_of]: crc32 is linear, so a prefix's value is moved on by the word's length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    moved = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    most = int(min(size.max(initial=0), _JOINED))
    zero, steps = _zero_byte(), [moved]
    for _ in range(most):
        moved = (moved >> np.uint32(8)) ^ zero[moved & np.uint32(255)]
        steps.append(moved)
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    out = np.stack(steps)[np.minimum(size, most)[word_of], prefix_of] ^ own[word_of]
    for k in np.flatnonzero(size[word_of] > most).tolist():
        out[k] = zlib.crc32(words[word_of[k]], zlib.crc32(prefixes[prefix_of[k]]))
    return out


def word_counts(docs: DataFrame, delete_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, A-Z lowered, and how often they come.

    With delete_every, a run of a document loses one code point where that number divides the crc32 of `<doc_id>:<run>`: the
    one at crc32 modulo length. A null id counts as empty there; null and empty texts have no words; repeated rows count as
    often as they come; words of any length are taken whole; an empty table gives no rows; other columns are not read. Counts
    are made in the tasks first, so a frequent word is a few rows of the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                part = b.slice(i, j - i)
                data, off = column_bytes(part.column(1))
                data = _LOWER[data]
                lead = data == _LATIN
                inside = _LETTER[data] | lead
                inside[1:] |= lead[:-1]
                start, end, text = runs_of(inside, off)
                if not len(start):
                    continue
                _, first, which = np.unique(segment_hash(prefix_sums(data), start, end), return_index=True, return_inverse=True)
                own = strings(*cut_out(data, start[first], end[first]))
                changed: Counter[str] = Counter()
                count = np.bincount(which, minlength=len(first))
                if delete_every:
                    ids = [b"" if x is None else str(x).encode() for x in part.column(0).to_pylist()]
                    h = joint_crc([x + b":" for x in ids], own.cast(pa.large_binary()).to_pylist(), text, which)
                    for k in np.flatnonzero(h % np.uint32(delete_every) == 0).tolist():
                        w = own[int(which[k])].as_py()
                        at = int(h[k]) % len(w)
                        changed[w[:at] + w[at + 1 :]] += 1
                        count[which[k]] -= 1
                words = pa.concat_arrays([own.cast(pa.string()), pa.array(changed.keys(), pa.string())])
                n = pa.array(np.concatenate([count, np.fromiter(changed.values(), np.int64, len(changed))]))
                found = pa.RecordBatch.from_arrays([words, n], ["word", "n"])
                yield found.filter(pc.and_(pc.greater(n, 0), pc.greater(pc.binary_length(words), 0)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, word number and place of every row of some words. The lowest bit of a key tells replacements from the rest.

    Replacements: the word without a place, with the place. Insertions: the word without a place, once for places that give
    the same, and the whole word.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    prefix = prefix_sums(code)
    _, down = powers(len(code) + 2)
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code))
    place = at - first[word]
    last = first + size
    cut = (prefix[at] - prefix[first[word]]) * down[first[word]] + (prefix[last[word]] - prefix[at + 1]) * down[first[word] + 1]
    cut = mix(cut + (size[word] - 1).astype(np.uint64) * np.uint64(MIX_1))
    whole = mix((prefix[last] - prefix[first]) * down[first] + size.astype(np.uint64) * np.uint64(MIX_1))
    replaced = mix(cut ^ mix(place.astype(np.uint64) + np.uint64(1)))
    once = np.ones(len(code), bool)
    once[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    one = np.uint64(1)
    key = np.concatenate([replaced | one, cut[once] & ~one, whole & ~one])
    return key.view(np.int64), np.concatenate([word, word[once], np.arange(len(words))]), np.concatenate([place, place[once], np.full(len(words), _WHOLE)])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches (key first) cut anew, so that the rows of a key stand together. A key has few rows."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        t = t if rest is None else pa.concat_tables([rest, t])
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        rest = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if rest is not None:
        yield rest


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key has several: for insertions only with a whole word and a longer one among them."""
    for t in _whole_groups(batches):
        key, place = t.column("key").to_numpy(), t.column("place").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        whole = np.add.reduceat(place == _WHOLE, new)
        fine = np.where(key[new] & 1, size > 1, (whole > 0) & (whole < size))
        yield from t.filter(pa.array(np.repeat(fine, size))).combine_chunks().to_batches()


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of a group that is near others of it: the word, how many, and the best of them (greatest n, then first)."""
    for t in _whole_groups(batches):
        groups: dict[tuple, list[tuple[int, str]]] = {}
        longer: dict[tuple, list[tuple[int, str]]] = {}
        for key, place, word, n in zip(*(t.column(c).to_pylist() for c in ("key", "place", "word", "n"))):
            rest = word if place == _WHOLE else word[:place] + word[place + 1 :]
            if key & 1:
                groups.setdefault((place, rest), []).append((-n, word))
            else:
                (groups if place == _WHOLE else longer).setdefault((_WHOLE, rest), []).append((-n, word))
        out: list[tuple[str, int, int, str]] = []
        for where, members in groups.items():
            if where[0] == _WHOLE:
                others = longer.get(where, [])
                if others:
                    best = min(others)
                    out += [(w, len(others), *best) for _, w in members]
                    out += [(w, len(members), *min(members)) for _, w in others]
            elif len(members) > 1:
                best, second = sorted(members)[:2]
                out += [(m[1], len(members) - 1, *(second if m == best else best)) for m in members]
        if out:
            w, near, n, by = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(by, pa.string())], ["word", "near", "minus_n", "other"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: of the words (distinct; word, n) that have near ones, how many, and the most frequent.

    Of equals the first in code-point order is best.
    """
    spark = words.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = words.select(F.xxhash64("word").alias("id"), "word", "n")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word, place = deletion_keys(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(word)), pa.array(place.astype(np.int32))], ["key", "id", "place"])

    made = known.select("id", "word").mapInArrow(keys, "key long, id long, place int")
    dealt = lambda df: df.repartition(n_tasks, "key").sortWithinPartitions("key")
    shared = written(dealt(made).mapInArrow(_shared, "key long, id long, place int"), "spelling-shared")
    # Words whose ids are equal come along for each other's keys; their strings part them.
    found = dealt(shared.join(known, "id").select("key", "place", "word", "n")).mapInArrow(_nearest, "word string, near long, minus_n long, other string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "other")).alias("best"))
    out = written(best.select("word", "n_near", (-F.col("best.minus_n")).alias("best_n"), F.col("best.other").alias("best")), "spelling-near")
    discard(shared)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last of the forms of forms. A form is more frequent by a factor, so none returns.

    Each round doubles the way, so few are needed.
    """
    far = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, far = far, written(far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(last)
        if far.where("moved").isEmpty():
            return far.select("word", "root")


def variants(counts: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n) of some length and count.

    form is the near word of greatest n (of equals the first in code-point order) if that n is at least factor times the
    word's, else null; root follows forms to the last, and is the word itself without one.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms lead to ever more frequent words")
    words = written(counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    near = near_words(words)
    rows = words.join(near, "word", "left").withColumn("_has", F.coalesce(F.col("best_n") >= F.col("n") * factor, F.lit(False)))
    rows = rows.select("word", F.when(F.col("_has"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_has"), F.col("best_n")).alias("form_n"))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(delete_every: int = 199, least_length: int = 6, least_count: int = 5, factor: int = 5) -> str:
    """variants(word_counts(documents, delete_every), ...) for DuckDB: the same words without a place, joined as strings."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, {_POLYNOMIAL}) ELSE c // 2 END) AS v FROM range(0, 256) r(b))),
t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run FROM documents),
d AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM t GROUP BY ALL),
p AS MATERIALIZED (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: unicode(c)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])) AS start FROM (SELECT DISTINCT doc_id FROM d), tab),
b AS MATERIALIZED (SELECT run, flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bytes FROM (SELECT DISTINCT run FROM d)),
h AS (SELECT run, n, xor(list_reduce(list_prepend(start, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM d JOIN p ON p.doc_id IS NOT DISTINCT FROM d.doc_id JOIN b USING (run), tab),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {delete_every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= {least_length} GROUP BY 1 HAVING sum(n) >= {least_count}),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, k.word, k.n FROM w JOIN k ON k.rest = w.word UNION SELECT k.word, w.word, w.n FROM w JOIN k ON k.rest = w.word),
best AS (SELECT word, count(*) AS n_near, (min((-n, other)))[1] AS m, (min((-n, other)))[2] AS other FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, CASE WHEN -m >= {factor} * w.n THEN other END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m >= {factor} * w.n THEN -m END::BIGINT AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.up IS NULL"""
