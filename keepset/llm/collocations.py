"""Phrases whose words belong together, counted by a multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, pieces into words.
Each word begins a suffix, its piece from there on, of which the first ``DEPTH`` words matter.

1. Single words are counted by a grouping. Each chunk of documents asks, by 32 bits besides a bucket,
   which of its neighbouring pairs of words occur ``LEAST`` times or more in all chunks (wrong hits cost
   work only), and cuts its suffixes at the first pair that does not: no longer phrase can be frequent.
2. What is left, equal suffixes of a chunk added up, is routed by the two leading words. Where a
   cell of such routes has more than ``HOT_ROWS`` rows, it is routed by three leading words, or by four,
   and the phrases shorter than the route are added up by a grouping.
3. A task sorts pointers to its suffixes: a segment is parted at a pivot word into less, equal and greater.
   The equal part is a phrase one word longer and its weight is the count; it goes on at the next
   word, the others at this one. Parts under ``LEAST`` are abandoned at once. All segments are
   parted in the same numpy pass, whatever their depth.
4. Candidates, phrases of 2 words or more, meet the counts of their two parts at every cut.

Null texts are empty, a null language is ``und``; repeated rows count each. No id is used, and other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepset.llm.arrow import released, runs
from keepset.llm.chunks import answered, bits, chunked, each_bucket, each_chunk, flags, mixed, texts_of
from keepset.llm.store import forget, stored, table

DEPTH = 4
LEAST = 30
TOP = 2000
INSIDE = 80  # per cent of a candidate that may lie within a longer one
SCALE = 2_000_000
NO_LANG = "und"
CELLS = 1 << 16
HOT_ROWS = 1 << 18
_AT_ONCE = 1 << 18         # rows sorted at a time, or one route
_BUCKET_BYTES = 12 << 20   # of text, for the pairs of one bucket
_SALT = 64
_LOW = np.uint64(0xFFFFFFFF)
_BREAK = b"A"  # no word holds a capital
_TABLE = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = [f"w{i}" for i in range(DEPTH)]
_ANSWER = "part int, chunk int, bucket int, bits binary"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, a break between pieces."""
    return text.translate(_TABLE).replace(b"\n", b" A ").split()


def _by_lang(row: dict) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a chunk, a language at a time."""
    found: dict[str, list[bytes]] = {}
    for tag, text in zip(row["tags"], texts_of(row), strict=True):
        held = found.setdefault(NO_LANG if tag is None else tag, [])
        held.extend(tokens(text))
        held.append(_BREAK)
    yield from sorted(found.items())


class _Pairs:
    """The pairs of neighbouring words in the pieces of a chunk's language."""

    def __init__(self, lang: str, words: list[bytes], buckets: int):
        number: dict[bytes, int] = {_BREAK: 0}
        self.ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        self.words = list(number)
        hashes = np.array([xxhash.xxh3_64_intdigest(w, 1) for w in self.words], dtype=np.uint64)[self.ids]
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 2))
        self.at = np.flatnonzero((self.ids[:-1] > 0) & (self.ids[1:] > 0))
        key = mixed(mixed(hashes[self.at] ^ seed) + hashes[self.at + 1])
        self.key = ((key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (key & _LOW)

    def suffixes(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes of two words or more as rows of word numbers (0: none), and how often each is here; ``frequent`` is by pair."""
        goes_on = np.zeros(len(self.ids) + DEPTH, dtype=bool)
        goes_on[self.at] = frequent
        start = np.flatnonzero(goes_on)
        rows = np.zeros((len(start), DEPTH), dtype=np.int64)
        ids, alive = np.append(self.ids, np.zeros(DEPTH, dtype=np.int64)), np.ones(len(start), dtype=bool)
        for depth in range(DEPTH):
            rows[alive, depth] = ids[start[alive] + depth]
            alive &= goes_on[start + depth]
        if not len(rows):
            return rows, np.empty(0, dtype=np.int64)
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        return rows[new], np.diff(np.append(new, len(rows)))


def _asked(row: dict, buckets: int) -> tuple[list[tuple[str, _Pairs]], np.ndarray, np.ndarray]:
    """The languages of a chunk, the distinct keys of all their pairs, and how often each is here."""
    langs = [(lang, _Pairs(lang, words, buckets)) for lang, words in _by_lang(row)]
    distinct, n = np.unique(np.concatenate([np.empty(0, np.uint64), *[p.key for _, p in langs]]), return_counts=True)
    return langs, distinct, n


def _spans(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.append(0, np.flatnonzero(np.diff(bucket)) + 1).tolist() if len(bucket) else []
    for a, e in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), a, e


def _frequent_pairs(chunks: DataFrame, buckets: int, least: int) -> DataFrame:
    """Answers: which pairs of a chunk may occur ``least`` times in all."""
    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        _, distinct, n = _asked(row, buckets)
        n = np.minimum(n, least).astype("<u4" if least > 255 else "<u1")
        for b, a, e in _spans((distinct >> np.uint64(32)).astype(np.int64)):
            yield pa.RecordBatch.from_pylist([{"bucket": b, "part": row["part"], "chunk": row["chunk"], "n": n[a:e].tobytes(),
                                               "keys": (distinct[a:e] & _LOW).astype("<u4").tobytes()}], sent)

    def answer(group: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = group.to_pylist()
        keys = [np.frombuffer(r["keys"], dtype="<u4") for r in rows]
        n = np.concatenate([np.frombuffer(r["n"], dtype="<u4" if least > 255 else "<u1") for r in rows])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        often = distinct[np.bincount(where, weights=n) >= least]
        yield pa.RecordBatch.from_pylist([{"part": r["part"], "chunk": r["chunk"], "bucket": r["bucket"],
                                           "bits": bits(np.isin(k, often, assume_unique=True))} for r, k in zip(rows, keys)], back)

    sent = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
    back = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
    asked = each_chunk(chunks, ask, "bucket int, part int, chunk int, keys binary, n binary")
    return each_bucket(asked, answer, _ANSWER, "frequent-pairs")


def _suffixes(chunks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """``lang, w0 .., n``: the suffixes of each chunk, cut at the first pair that is not frequent."""
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        langs, distinct, _ = _asked(row, buckets)
        found = {a["bucket"]: a["bits"] for a in row["pairs"] or ()}
        often = np.zeros(len(distinct), dtype=bool)
        for b, a, e in _spans((distinct >> np.uint64(32)).astype(np.int64)):
            often[a:e] = flags(found[b], e - a)
        for lang, pairs in langs:
            rows, n = pairs.suffixes(often[np.searchsorted(distinct, pairs.key)])
            if len(rows):
                names = pa.array([None, *pairs.words[1:]], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *[names.take(pa.array(rows[:, d])) for d in range(DEPTH)],
                                                  pa.array(n, pa.int64())], ["lang", *_WORDS, "n"])

    schema = f"lang string, {', '.join(f'{w} string' for w in _WORDS)}, n long"
    return each_chunk(answered(chunks, pairs=answers), work, schema)


def sorted_counts(words: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``depth, row, count`` of each prefix of weight ``least`` or more, told by its depth and one row that has it.

    ``words`` are the numbers of the first, second, .. word of each row, negative where it has ended.
    A three-way quicksort of pointers over several keys; all segments take a step at once.
    """
    keys, pointer = np.stack(words), np.arange(len(weight))
    begin, depth, out = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
    while len(pointer):
        size = np.diff(np.append(begin, len(pointer)))
        segment = np.repeat(np.arange(len(begin)), size)
        word = keys[depth[segment], pointer]
        pivot = word[begin + size // 2]
        side = 1 + (word > pivot[segment]).astype(np.int64) - (word < pivot[segment])
        part = 3 * segment + side
        n = np.bincount(part, minlength=3 * len(begin))
        heavy = np.bincount(part, weights=weight[pointer], minlength=3 * len(begin))
        to = np.empty(len(pointer), dtype=np.int64)
        first = np.cumsum(n) - n
        for s in range(3):  # stable within each part
            here = side == s
            seen = np.cumsum(here)
            to[here] = first[part[here]] + (seen - (seen - here)[begin][segment])[here] - 1
        moved = np.empty_like(pointer)
        moved[to] = pointer
        equal, going = np.arange(3 * len(begin)) % 3 == 1, heavy >= least
        deeper = np.repeat(depth, 3) + equal
        going &= ~equal | (np.repeat(pivot, 3) >= 0)
        out += zip(deeper[going & equal].tolist(), moved[first[going & equal]].tolist(), heavy[going & equal].astype(np.int64).tolist())
        going &= deeper < len(words)
        stays = np.repeat(going, n)
        pointer, depth, size = moved[stays], deeper[going], n[going]
        begin = np.cumsum(size) - size
    return out


def _counted(rows: DataFrame, routed: int, least: int) -> DataFrame:
    """``lang, phrase, k, f`` of the frequent phrases of ``routed`` words or more; rows are routed by so many words."""
    route = [*_WORDS[:routed], "lang"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            group = pa.concat_tables(held).combine_chunks()
            columns = [group.column(c).combine_chunks().dictionary_encode() for c in ("lang", *_WORDS)]
            codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
            found = [f for f in sorted_counts(codes, group.column("n").to_numpy(), least) if f[0] > routed]
            if found:
                names = [c.dictionary.to_pylist() for c in columns]
                word = [[names[d][codes[d][row]] for d in range(depth)] for depth, row, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in word], pa.string()), pa.array([" ".join(w[1:]) for w in word], pa.string()),
                                                  pa.array([d - 1 for d, _, _ in found], pa.int32()), pa.array([f for _, _, f in found], pa.int64())],
                                                 ["lang", "phrase", "k", "f"])

        for run in runs(batches, route):
            held.append(run)
            size += run.num_rows
            if size >= _AT_ONCE:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    long_enough = rows.where(F.col(route[-2]).isNotNull())  # a shorter suffix holds no phrase of so many words
    return long_enough.repartition(*route).sortWithinPartitions(*route).mapInArrow(released(work), "lang string, phrase string, k int, f long")


def _grouped(rows: DataFrame, k: int, least: int) -> DataFrame:
    """The same for phrases of exactly ``k`` words by a grouping."""
    names = ["lang", *_WORDS[:k]]
    return (rows.where(F.col(names[-1]).isNotNull()).groupBy(names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
            .select("lang", F.concat_ws(" ", *names[1:]).alias("phrase"), F.lit(k).alias("k"), "f"))


def frequent_phrases(rows: DataFrame, least: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``lang, phrase, k, f`` of all phrases of two words or more in ``least`` suffixes or more."""
    found = None
    for routed in range(2, DEPTH):
        cell = F.pmod(F.xxhash64("lang", *_WORDS[:routed]), F.lit(CELLS)).cast("int")
        hot = [r[0] for r in rows.groupBy(cell.alias("cell")).count().where(F.col("count") > hot_rows).select("cell").collect()]  # at most CELLS numbers
        cold = _counted(rows.where(~cell.isin(hot)) if hot else rows, routed, least)
        found = cold if found is None else found.union(cold)
        if not hot:
            return found
        rows = rows.where(cell.isin(hot))
        found = found.union(_grouped(rows, routed, least))
    return found.union(_grouped(rows, DEPTH, least))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    ``a`` is how often a phrase occurs, ``l`` and ``r`` its two parts at the cut where ``score``, ``SCALE * a / (l + r)``
    rounded down, is least, ``n`` all words of the language. Phrases lying inside a longer one most of the time go.
    """
    chunks = chunked(docs.select(F.lit(None).cast("long").alias("id"), F.col(lang_col).alias("tag"), F.col(text_col).alias("text")))
    buckets = max(1, -(-(chunks.agg(F.sum("n_bytes")).first()[0] or 0) // _BUCKET_BYTES))

    def single(row: dict) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_lang(row):
            counts = Counter(words)
            del counts[_BREAK]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["lang", "phrase", "f"])

    words = stored(each_chunk(chunks, single, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    suffixes = stored(_suffixes(chunks, _frequent_pairs(chunks, buckets, least), buckets), "suffixes")
    forget(chunks)
    longer = frequent_phrases(suffixes, least, hot_rows)
    grams = stored(words.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("k"), "f").union(longer), "phrases")
    forget(suffixes)
    return _best(grams, totals, top)


def _best(grams: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    split = grams.where("k > 1").withColumn("words", F.split("phrase", " "))
    cut = split.select("lang", "phrase", F.col("f").alias("a"), F.expr("explode(sequence(1, k - 1))").alias("cut"), "words")
    cut = cut.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("head"),
                     F.expr("array_join(slice(words, cut + 1, size(words)), ' ')").alias("tail"))
    parts = grams.select("lang", "phrase", "f")
    cut = (cut.join(parts.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"])
           .join(parts.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]))
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l + r as decimal(20,0))")
    scored = (cut.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    inner = split.where("k > 2").select("lang", "f", F.expr(
        "explode(flatten(transform(sequence(2, k - 1), w -> transform(sequence(1, k - w + 1), i -> array_join(slice(words, i, w), ' ')))))").alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    left = (scored.join(covered, ["lang", "phrase"], "left").where(f"within IS NULL OR 100 * within < {INSIDE} * a")
            .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALT))
    first = left.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def document_collocations(spark, sf_dir: str) -> DataFrame:
    """``op12_collocations``: the best phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """``op12_collocations`` in SQL: all n-grams of all pieces."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH pieces AS (
      SELECT coalesce(lang, '{NO_LANG}') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
    starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
    grams AS (
      SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM starts, range(1, {DEPTH + 1}) sizes(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
    often AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM grams WHERE f >= {LEAST}),
    cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS tail
             FROM often, range(1, {DEPTH}) cut(c) WHERE k > 1 AND c < k),
    scored AS (SELECT cuts.lang, cuts.phrase, a, c, h.f AS l, t.f AS r, (({SCALE}::HUGEINT * a) // (h.f + t.f))::BIGINT AS score
               FROM cuts JOIN often h ON h.lang = cuts.lang AND h.phrase = head JOIN often t ON t.lang = cuts.lang AND t.phrase = tail
               QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1),
    inside AS (SELECT lang, array_to_string(ws[i:i + w - 1], ' ') AS phrase, max(f) AS within
               FROM often, range(2, {DEPTH}) widths(w), range(1, {DEPTH}) starts(i) WHERE w < k AND i + w - 1 <= k GROUP BY ALL)
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, n, score
    FROM scored s JOIN totals USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE within IS NULL OR 100 * within < {INSIDE} * a
    QUALIFY rank <= {TOP}"""
