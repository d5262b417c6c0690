"""BPE encoding and decoding of whole texts with public tokenizer files.

``TreeEncoder`` is tree concatenation: a text longer than a leaf is halved until its parts are leaves, the leaves are
encoded, and a join of two encoded parts encodes a window around it anew, twice as wide each time, until the outermost
tokens on both sides are those that stood there before. A BPE sequence is right when each adjacent pair of its tokens
is, and the pairs across the window's ends are pairs that an encoded half had. The window is wider than the special
token, whose text could span a join. ``encode_decode`` gives texts above ``SPLIT_CHARS`` to Spark as such halves, one row
each, so that the parts of one very long text are encoded by different tasks.

``ByteEncoder`` is the leaf encoder of byte-level files; the ranks and the special token come from the tokenizers
library's own file, and the tests hold its ids against that library's. ``WordEncoder`` is for files with word ends
that drop white space: words are independent there, so the library encodes each distinct word once a worker.

Defined cases: a null text counts as empty (no ids, empty decoded text); repeated rows come back repeated; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, text_column

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct words a worker remembers; beyond that it keeps the quarter that came first, so its memory is bounded.
CACHE_WORDS = 1_000_000
#: Words of letters that the library encodes as one text.
JOINT_WORDS = 64
#: Characters of a leaf; a longer text is halved.
LEAF_CHARS = 4096
#: Characters above which the halves of a text are rows of their own, for different tasks.
SPLIT_CHARS = 32_768
#: Tokens that the first window takes on each side of a join: more than the special token has characters.
WINDOW = 16
#: The pre-tokenizer's pattern of byte-level files, fixed by their format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def library(path: str):
    """The tokenizers library's object, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_table(path: str) -> tuple[list[bytes], dict[str, int]]:
    """The bytes of each id of a byte-level file, and its special tokens.

    Such files write bytes as printable characters by a rule: printable Latin-1 bytes stand for themselves, the others
    follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = dict(zip(map(chr, shown), shown, strict=True))
    hidden = [b for b in range(256) if b not in set(shown)]
    letter.update(zip(map(chr, range(256, 256 + len(hidden))), hidden, strict=True))
    tokenizer = library(path)
    special = {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items()}
    tokens = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [x.encode() if x in special else bytes(letter[c] for c in x) for x in tokens], special


NOTHING = np.zeros(0, "<u4")


class ByteEncoder:
    """Byte-level ids of a text; its special tokens are recognised in the text, as the tokenizers library does."""

    def __init__(self, path: str):
        import tiktoken

        self.token_bytes, self.special = byte_table(path)
        ordinary = {x: i for i, x in enumerate(self.token_bytes) if i not in set(self.special.values())}
        self.core = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ordinary, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


class TreeEncoder(ByteEncoder):
    """Encodes long texts by halves and windows around their joins; decodes ids."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW):
        super().__init__(path)
        self.leaf, self.window = leaf, window

    def tree(self, text: str) -> np.ndarray:
        parts = halves(len(text), self.leaf)
        return self.merge([self.encode(text[a:b]) for a, b in parts])

    def merge(self, parts: list[np.ndarray]) -> np.ndarray:
        """The encoding of the joined texts of adjacent ``parts``, level by level of the tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, "<u4")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        size = self.window
        while len(left) and len(right):
            a, b = max(0, len(left) - size), min(len(right), size)
            try:
                middle = self.encode(self.text_of(np.concatenate([left[a:], right[:b]])).decode())
            except UnicodeDecodeError:  # an end of the window cuts a character
                middle = NOTHING
            left_agrees = a == 0 or len(middle) > 1 and (middle[:2] == left[a : a + 2]).all()
            right_agrees = b == len(right) or len(middle) > 1 and (middle[-2:] == right[b - 2 : b]).all()
            if (len(middle) or not (a or b < len(right))) and left_agrees and right_agrees:
                return np.concatenate([left[:a], middle, right[b:]])
            size *= 2
        return np.concatenate([left, right])

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.text_of(ids).decode("utf-8", errors="replace")


def halves(n: int, most: int) -> list[tuple[int, int]]:
    """The parts of 0..n after halving until none is longer than ``most``: a power of two of them."""
    parts = 1
    while n > parts * most:
        parts *= 2
    cuts = [n * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once while it is remembered.

    Right for files whose normaliser and pre-tokenizer never join characters over ASCII white space and drop it.
    Words get numbers as they come; the ids of all of them stand in one growing array.
    """

    class Numbers(dict):
        def __init__(self):
            super().__init__()
            self.new: list[bytes] = []

        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            self.new.append(word)
            return n

    def __init__(self, path: str):
        self.tokenizer = library(path)
        letters = "A B C D E F G H I J K L M N O P Q R S T U V W X Y Z"
        same = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (letters, letters.lower()))
        self.folds = next(same) == next(same)  # the file doesn't tell A-Z from a-z
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size() if suffix else 0
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith(suffix) for i in range(size)], bool)
        self.numbers, self.done = self.Numbers(), 0
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def forget(self) -> None:
        """Keep the quarter of the words that came first, the common ones among them."""
        kept = self.Numbers()
        kept.update(islice(self.numbers.items(), CACHE_WORDS // 4))
        self.numbers, self.done = kept, len(kept)
        self.used = int(self.starts[self.done - 1] + self.sizes[self.done - 1])

    def words(self, text: str) -> list[bytes]:
        """What stands between ASCII white space, in lower case where the file makes no difference: special tokens are
        sought in the text as it is, and a combining mark may join the lower-case letter only. All marks that join a
        letter of ASCII stand in U+0300 to U+037F, whose first bytes are 0xCC and 0xCD."""
        raw = text.encode()
        if self.folds and b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return raw.split()

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The library's ids of each word. Words of letters alone go to it many in a text, as each has one last token."""
        lone = [i for i, w in enumerate(words) if not len(self.ends) or not w.isalpha()]
        apart = set(lone)
        joint = [i for i in range(len(words)) if i not in apart]
        groups = [joint[k : k + JOINT_WORDS] for k in range(0, len(joint), JOINT_WORDS)]
        texts = [" ".join(words[i] for i in group) for group in groups] + [words[i] for i in lone]
        found = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[np.ndarray] = [NOTHING] * len(words)
        for group, ids in zip(groups, found, strict=False):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                own = np.split(ids, cuts[:-1])
            else:  # the file cuts letters otherwise
                own = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([words[i] for i in group], add_special_tokens=False)]
            for i, x in zip(group, own, strict=True):
                out[i] = x
        for i, ids in zip(lone, found[len(groups) :], strict=True):
            out[i] = ids
        return out

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        for at in range(0, len(new), 8192):
            found = self._encoded([w.decode() for w in new[at : at + 8192]])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            total, to = int(sizes.sum()), self.done + len(found)
            self.pool = self._room(self.pool, self.used + total)
            self.pool[self.used : self.used + total] = np.concatenate(found)
            self.starts, self.sizes = self._room(self.starts, to), self._room(self.sizes, to)
            self.sizes[self.done : to] = sizes
            self.starts[self.done : to] = self.used + np.cumsum(sizes) - sizes
            self.used, self.done = self.used + total, to

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > CACHE_WORDS:
            self.forget()
        number = self.numbers.__getitem__
        words = [np.fromiter(map(number, cut), np.int64, len(cut)) for cut in map(self.words, texts)]
        if self.done < len(self.numbers):
            self._learn()
        out = []
        for w in words:
            sizes = self.sizes[w]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(w) else 0
            out.append(self.pool[np.repeat(self.starts[w] - ends + sizes, sizes) + np.arange(total)])
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker and file, so that what it remembers serves all its tasks."""
    return WordEncoder(path)


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


_DIGEST = "doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(keys: pa.Array, ids: list[np.ndarray], path: str) -> pa.RecordBatch:
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    decode = tree_encoder(path).decode
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(x.tobytes()) for x in ids], pa.string()),
            pa.array([sha(decode(x).encode()) for x in ids], pa.string()),
        ],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def long_ids(long: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of long texts -> (doc_id, copies, ids binary): halves encoded as rows of their own, then joined.

    Repeated rows are counted first, so that one key never gathers more than one text's halves.
    """
    counted = long.groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    size = F.char_length("text")
    parts = F.greatest(F.lit(1), F.pow(2, F.ceil(F.log2(size / SPLIT_CHARS))).cast("int"))
    cut = lambda i: F.floor(size.cast("long") * i / F.col("parts")).cast("int")
    rows = (
        counted.withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("doc_id", "sha", "copies", "part", F.substring("text", cut(F.col("part")) + 1, cut(F.col("part") + 1) - cut(F.col("part"))).alias("text"))
        .repartition("doc_id", "sha", "part")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(path).tree
        for batch in batches:
            ids = pa.array([tree(x.as_py()).tobytes() for x in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids], names=["doc_id", "sha", "copies", "part", "ids"])

    kind = long.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(encode, f"doc_id {kind}, sha string, copies long, part int, ids binary")
    gathered = encoded.groupBy("doc_id", "sha").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = tree_encoder(path).merge
        for batch in batches:
            for i, parts in enumerate(batch.column(2)):
                ids = merge([np.frombuffer(x.as_py(), "<u4") for x in parts]).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([ids], pa.binary())], names=["doc_id", "copies", "ids"])

    return gathered.select("doc_id", "copies", "parts.ids").mapInArrow(join, f"doc_id {kind}, copies long, ids binary")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids_sha256`` (little-endian 32-bit ids), ``decoded_sha256``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("doc_id"), text_column(docs, text).alias("text")))
    schema = _DIGEST.format(kind=kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(path).tree
        for batch in batches:
            yield _digests(batch.column(0), [tree(x.as_py()) for x in batch.column(1)], path)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digests(batch.column(0), [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)], path)

    short = rows.where(F.char_length("text") <= SPLIT_CHARS).mapInArrow(whole, schema)
    long = long_ids(rows.where(F.char_length("text") > SPLIT_CHARS), path)
    copies = long.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "ids")
    return short.unionByName(copies.mapInArrow(joined, schema))
