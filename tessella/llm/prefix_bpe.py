"""BPE encoding by prefix-sharing trie traversal.

The distinct words of a slice of documents go into a trie of symbols. A depth-first walk gives each node the
last token of the encoding of the prefix that it stands for: the one token that ends there and may follow the
last token of the prefix before it. A shared prefix is so encoded once, and a word's tokens are read back
along its path. Words found are kept in a bounded cache for later slices of the task.

Nulls are empty texts; an empty text has no token. doc_id may be null or repeat: each row is encoded alone. An empty
table has no rows. A long text is encoded whole, in one slice of its own. Of documents only doc_id and text are read;
other columns may have any names.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_texts, read, text_or_empty

#: Words that a task keeps with their tokens.
CACHE_WORDS = 400_000
#: Latin text, on which all Unicode versions agree and composition changes nothing.
PLAIN = re.compile("[\t-\r -~¡-įı-ɏ]*")
#: Fixed value: the vocabulary's own word pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> dict[int, str]:
    """Byte-level symbols: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixTrie:
    """Encodes sets of words, given as strings of byte-level symbols, with a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.longest = max(len(t.removesuffix(end)) for t in vocab)
        self.made = {a + b: (a, b) for a, b in merges}
        self._may_follow: dict[tuple[str, str], bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """The plain rule: again and again the leftmost pair of the best rank."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts at the token's start (side 0) or end (1), smallest first, each with the rank that consumes it."""
        found = self._spines[side].get(token)
        if found is None:
            out, consumed = [], len(self.rank)
            while True:
                out.append((token, consumed))
                if token not in self.made:
                    break
                consumed = self.rank[self.made[token]]
                token = self.made[token][side]
            found = self._spines[side][out[0][0]] = out[::-1]
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether the two tokens' text, encoded alone, gives just these two (left may be empty).

        The parts that meet at the border are followed in the order of the merges that consume them; the
        tokens stay apart if no merge across the border comes first. Of equal ranks the leftmost comes first.
        """
        key = (left, right)
        if (found := self._may_follow.get(key)) is not None:
            return found
        if not left:
            found = self.merge(self.symbols(right)) == [right]
        else:
            if len(self._may_follow) > 1_000_000:
                self._may_follow.clear()
            ends, starts, i, j = self.spine(left, 1), self.spine(right, 0), 0, 0
            never = len(self.rank)
            while True:
                (x, x_until), (y, y_until) = ends[i], starts[j]
                across = self.rank.get((x, y), never)
                if across < x_until and across <= y_until and across < never:
                    found = False
                    break
                if x_until == y_until == never:
                    found = True
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
        self._may_follow[key] = found
        return found

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """The tokens of each word."""
        root: dict = {}
        for word in words:
            node = root
            for symbol in [*word[:-1], word[-1] + self.end]:
                node = node.setdefault(symbol, {})
        out: dict[str, list[str]] = {}
        longest, vocab, end, memo = self.longest, self.vocab, self.end, self._may_follow
        path: list[str] = []
        last: list[str] = [""]
        stack = [(1, s, child) for s, child in root.items()]
        while stack:
            depth, symbol, node = stack.pop()
            del path[depth - 1 :], last[depth:]
            path.append(symbol)
            token = ""
            for at in range(depth - 1, max(-1, depth - 1 - longest), -1):
                token = path[at] + token
                if token in vocab:
                    before = last[at]
                    apart = memo.get((before, token))
                    if self.may_follow(before, token) if apart is None else apart:
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at {token!r}")
            if symbol.endswith(end) and len(symbol) > len(end):
                tokens, at = [], depth
                while at:
                    tokens.append(token := last[at])
                    at -= len(token.removesuffix(end)) if at == depth else len(token)
                out["".join(path)[: -len(end)]] = tokens[::-1]
            stack.extend((depth + 1, s, child) for s, child in node.items())
        return out


class WordTokenizer:
    """Encodes texts as the tokenizers library does with the same file; holds a bounded word cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = PrefixTrie(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.bytes = byte_symbols()
        self.known: dict[str, tuple[int, str, str]] = {c: (1, str(i), c) for c, i in self.special.items()}
        self.fixed = len(self.known)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, in byte-level symbols if they aren't ASCII."""
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [self.raw(w) for w, _ in pieces]

    def raw(self, mapped: str) -> str:
        back = self._back
        return bytes(back[c] for c in mapped).decode("utf-8")

    @functools.cached_property
    def _back(self) -> dict[str, int]:
        return {c: b for b, c in self.bytes.items()}

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its words as (tokens, ids, token strings), the last two joined by a space."""
        split = [[w for i, part in enumerate(self.split.split(t)) for w in ([part] if i % 2 else self.words(part))] if "<|" in t else self.words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            for w in [*self.known][self.fixed :]:
                del self.known[w]
        new = {w for words in split for w in words} - self.known.keys()
        symbols = {w: w if w.isascii() and w.isprintable() and " " not in w else "".join(map(self.bytes.__getitem__, w.encode())) for w in new}
        gc.disable()  # a trie has many small dicts and no cycles
        found = self.trie.encode([*symbols.values()])
        gc.enable()
        vocab = self.trie.vocab
        for w, s in symbols.items():
            tokens = found[s]
            self.known[w] = (len(tokens), " ".join(str(vocab[t]) for t in tokens), " ".join(tokens))
        known = self.known
        return [[known[w] for w in words] for words in split]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and (with_ids) the ids and the decoded text of each row of docs (doc_id, text)."""

    def make():
        tok = tokenizer(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            rows = tok.encode(texts)
            counts = [sum(w[0] for w in r) for r in rows]
            if with_ids:
                ids = [[int(i) for w in r for i in w[1].split(" ")] for r in rows]
                decoded = [" ".join([w[2] for w in r]) for r in rows]
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])
            sha = lambda k: pa.array([hashlib.sha256(" ".join([w[k] for w in r]).encode()).hexdigest() for r in rows], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), sha(1), sha(2)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return run

    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded string" if with_ids else "ids_sha256 string, decoded_sha256 string")
    return map_texts(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), make, schema)


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The digests of every document's ids and decoded text; see the module for nulls and repeated rows."""
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
