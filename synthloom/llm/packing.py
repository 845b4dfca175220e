"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthloom.llm.common import runs, table, written

ROOM = 4096
END = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Pieces a packing group is meant to hold: what bounds a task's memory, at any size of the input.
GROUP_ROWS = 16384
#: Bytes of words, their ids and what Python keeps with them that a task remembers; all are forgotten when there are more.
KNOWN_BYTES = 48 << 20
ENTRY_BYTES = 220
#: A sequence filled less than this is packed once more, with those of the other groups.
FULL = 0.99

# white space for Arrow that is none for the tokenizer
_ODD = "[\x1c-\x1f]"
# what the tokenizer makes of ASCII words in lower case: each part's last id closes a word
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# a letter and a mark after it, which the tokenizer parts; "<|" begins its special tokens
_LETTER_MARK, _SPECIAL = r"([a-zA-Z\p{Ll}\p{Lo}])([^\s\pL\pN\pM'])", "<|"


def _laid_out(values: np.ndarray, begins: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values that `at` names, one after another, and where each of them begins (and the end)."""
    n = length[at]
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    return values[np.repeat(begins[at] - upto[:-1], n) + np.arange(upto[-1])], upto


class WordIds:
    """The ids of texts by way of the ids of their different words, and these by way of their parts. One lives as long as its task.

    The tokenizer never joins what white space parts, nor letters with marks that follow them, and it ignores case. Arrow
    finds the different words and their different parts, and only parts that are new are coded.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def coded(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in out]

    def coded_at_once(self, words: list[str], parts: np.ndarray) -> list[bytes]:
        """Words coded as one text and parted where the ids close as many words as each has parts."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != parts.sum() or len(ends) and ends[-1] != 4 * len(ids):  # a letter fell apart when normalised
            return self.coded(words)
        raw, at = ids.tobytes(), 0
        return [raw[at : (at := end)] for end in ends[np.cumsum(parts) - 1].tolist()]

    def learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        plain = [w for w in words if not w.isalpha() and w.isascii() and _SPECIAL not in w]
        others = [w for w in words if not w.isalpha() and (not w.isascii() or _SPECIAL in w)]
        counts = np.fromiter((len(_PARTS.findall(w)) for w in plain), np.int64, len(plain))
        self.known.update(zip(letters, self.coded_at_once(letters, np.ones(len(letters), np.int64)), strict=True))
        self.known.update(zip(plain, self.coded_at_once(plain, counts), strict=True))
        self.known.update(zip(others, self.coded(others), strict=True))
        self.held += sum(len(w) + len(self.known[w]) + ENTRY_BYTES for w in words)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and the end)."""
        if self.held > KNOWN_BYTES:
            self.known, self.held = {"": b""}, 0
        words = pc.utf8_split_whitespace(texts)
        word = words.flatten().dictionary_encode()
        parted = pc.replace_substring_regex(pc.ascii_lower(word.dictionary), _LETTER_MARK, r"\1 \2")
        parts = pc.split_pattern(pc.if_else(pc.match_substring(word.dictionary, _SPECIAL), word.dictionary, parted), " ")
        part = parts.flatten().dictionary_encode()
        different = part.dictionary.to_pylist()
        self.learn([w for w in different if w not in self.known])
        ids = list(map(self.known.__getitem__, different))
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        by_word, upto = _laid_out(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length, length, part.indices.to_numpy())
        edges = upto[parts.offsets.to_numpy()]
        out, upto = _laid_out(by_word, edges[:-1], np.diff(edges), word.indices.to_numpy())
        edges = upto[words.offsets.to_numpy()]
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        if not len(odd):
            return out, edges
        whole = [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in odd.tolist():
            whole[i] = np.frombuffer(self.coded([texts[i].as_py()])[0], "<u4")
        return np.concatenate(whole), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in whole])])


def token_pieces(docs: DataFrame, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """docs as pieces of at most `room` tokens: id_col, piece, start, length, ids_crc32. Only longer documents are cut.

    A document's ids end with `end`, so null and empty texts make a piece of one id. Texts are coded whole.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    last = int(end).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = WordIds(tokenizer)
        for batch in batches:
            for run in runs(batch, text_col):
                row, piece, start, length, crc = [], [], [], [], []
                ids, edges = code.of(pc.fill_null(run.column(text_col), ""))
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    raw = ids[a:b].tobytes() + last
                    for k, at in enumerate(range(0, len(raw), 4 * room)):
                        part = raw[at : at + 4 * room]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [run.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col)).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece.

    A bin is filled greedily, longest fitting piece first. Then its smallest piece is replaced by the two unpacked pieces
    that fill the gap it leaves the most tightly, if they fill more than it did.
    """
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=room + 1)
    used = np.concatenate([[0], np.cumsum(count)])[:-1]  # of each length, the next piece to take, as a place in order
    sizes = np.arange(room + 1)
    floor = np.maximum.accumulate(np.where(count > 0, sizes, 0))  # the largest unpacked length up to each
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, made = len(lengths), 0
    while left:
        free, inside = room, []
        while x := int(floor[free]):
            n = min(int(count[x]), free // x)
            inside += [x] * n
            free -= n * x
            count[x] -= n
            if not count[x]:
                floor = np.maximum.accumulate(np.where(count > 0, sizes, 0))
        if free and len(inside) > 1:
            smallest = inside[-1]
            gap = free + smallest
            a = np.flatnonzero(count[: gap + 1])
            b = floor[np.minimum(gap - a, a)]
            b = np.where((b == a) & (count[a] < 2), floor[np.maximum(np.minimum(gap - a, a) - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            best = int(np.argmax(both)) if len(both) else 0
            if len(both) and both[best] > smallest:
                inside[-1:] = [int(a[best]), int(b[best])]
                count[a[best]] -= 1
                count[b[best]] -= 1
                count[smallest] += 1
                floor = np.maximum.accumulate(np.where(count > 0, sizes, 0))
        at = 0
        for x in inside:
            item = order[used[x]]
            used[x] += 1
            bins[item], offsets[item] = made, at
            at += x
        left -= len(inside)
        made += 1
    return bins, offsets


def pack(
    docs: DataFrame, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end: int = END, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Pack all documents into sequences of at most `room` tokens.

    Pieces are dealt to groups of about group_rows by their place in a written table, as many groups as there have to be,
    and each is packed by best_two_fit. What its last sequences leave open is dealt out again, with that of the other
    groups, until one group holds it or another round would gain little: so no task meets more than about group_rows pieces,
    repeated rows part like others, and the open ends of all groups are shared. A sequence belongs to one group;
    sequence_id holds that group in its upper half.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one end token; texts of
    any length are read whole; null ids and repeated rows are packed like others; of equally long pieces any comes first;
    an empty table gives no row; other columns are not read, whatever their names.
    """
    rows = written(token_pieces(docs, room, id_col, text_col, tokenizer, end), "pieces")
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])
    done: list[DataFrame] = []
    made, before = 0, None
    while True:
        n = rows.count()
        groups = max(1, -(-n // group_rows))
        dealt = rows.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        packed = dealt.groupBy("_group").applyInArrow(_placer(room, made), schema)
        if groups == 1 or before is not None and 2 * n > before:
            done.append(packed)
            break
        packed = written(packed, "packed")
        done.append(packed.filter(F.col("_fill") >= FULL * room))
        rows = packed.filter(F.col("_fill") < FULL * room).select(*columns)
        made, before = made + groups, n
    return reduce(DataFrame.unionByName, done).drop("_fill")


def _placer(room: int, made: int) -> Callable[[pa.Table], pa.Table]:
    """What packs a group; groups of earlier rounds have the numbers below `made`."""

    def place(group: pa.Table) -> pa.Table:
        number = int(group.column("_group")[0].as_py()) + made
        group = group.drop_columns(["_group"]).sort_by([("ids_crc32", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_numpy()
        bins, offsets = best_two_fit(lengths, room)
        fill = np.bincount(bins, lengths).astype(np.int64)
        for name, values in (("sequence_id", bins + (number << 32)), ("offset", offsets), ("_fill", fill[bins])):
            group = group.append_column(name, pa.array(values))
        return group

    return place


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
