"""BPE encoding and decoding by tree concatenation, exact against the ``tokenizers`` library.

Text that the tokenizer's pre-tokenizer doesn't split is cut into halves until the leaves are short; the
leaves are encoded in one batch call, in parallel threads of the library, and neighbours are joined bottom-up. At a join a window of tokens on
both sides is encoded anew. When the window's first token is the left side's token at that place and
its last token is the right side's, both sides agree and the window replaces the seam; else it grows,
at the most to both whole sides. Agreement is exact, not a guess: a token sequence is the BPE encoding
of its text if and only if each adjacent pair is the encoding of the pair's text, and with the
overlap of one token on either side every adjacent pair of the result lies inside the left side, the
window or the right side.

The same tree works on whole texts: they are halved at any code point, each leaf is split at ASCII
white space (where this tokenizer always splits and no normaliser reaches across), and at a join the
window grows from the seam to the white space on both sides. Units of a corpus repeat, so a bounded
memo keeps the encodings of short ones.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, table

_SPACES = re.compile(r"[ \t\n\r]+")
#: Code points of a leaf of text; of unsplit text that goes to the library whole; tokens of the first window.
LEAF_TEXT, LEAF_WORD, WINDOW, MEMO = 1 << 14, 256, 8, 1 << 18

#: The pre-tokenizer's pattern in the tokenizer file (a fixed value), and the same narrowed to Latin-1 text in lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾", "\x09-\x0d\x20\x85\xa0"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"


def _byte_alphabet() -> list[str]:
    """The code point by which byte-level BPE writes each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _bare(path: str, suffix: bool):
    """A tokenizer of the same merges that takes its input as one word; without ``suffix`` for a piece that ends inside a word."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
    if not suffix:
        spec["model"]["end_of_word_suffix"] = None
    return Tokenizer.from_str(json.dumps(spec))


class TreeEncoder:
    """Encodes and decodes whole texts; ``path`` is a tokenizers file whose model is BPE."""

    def __init__(self, path: str, leaf_text: int = LEAF_TEXT, leaf_word: int = LEAF_WORD, window: int = WINDOW):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")  # for batches of leaves; all else is encoded one by one
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf_text, self.leaf_word, self.window = leaf_text, leaf_word, window
        self.path, self._whole, self._inner = path, None, None
        self.memo: tuple[dict[str, tuple[int, str, str]], ...] = ({}, {})
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.tokens = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        # Latin-1 text is its own NFC form and its letters and digits are few, so there Python's expressions split as the file's own pattern does.
        self.latin = self.tok.decoder is None and f'"{_PATTERN}"' in json.dumps(json.loads(self.tok.to_str())["pre_tokenizer"]).replace("\\\\", "\\")
        self._latin, self._outside = re.compile(_LATIN), re.compile("[^\x00-\xff]")
        self._bytes = _byte_alphabet()
        self._special_at = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    # --- unsplit text -------------------------------------------------------------------------

    def _pieces(self, texts: list[str], last: bool) -> list[list[tuple[int, int]]]:
        """(id, length in the word's alphabet) of the tokens of each text, encoded in parallel; ``last``: the last one ends the word."""
        if self._inner is None:
            self._whole, self._inner = _bare(self.path, True), _bare(self.path, False)
        inner = texts[:-1] if last else texts
        got = self._inner.encode_batch_fast(inner, add_special_tokens=False) if inner else []
        if last:
            got.append(self._whole.encode(texts[-1], add_special_tokens=False))
        return [[(i, self._width(i)) for i in e.ids] for e in got]

    def _width(self, i: int) -> int:
        return len(self.tokens[i].removesuffix("</w>")) if i in self.tokens else 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token (its byte alphabet is ASCII or two-byte code points), by tree concatenation."""
        if len(word) <= self.leaf_word:
            return [t.id for t in self.model.tokenize(word)]
        n, parts = len(word), 1
        while n / parts > self.leaf_word:
            parts *= 2
        cuts = [n * i // parts for i in range(parts + 1)]
        leaves = self._pieces([word[cuts[i] : cuts[i + 1]] for i in range(parts)], True)
        level = [(cuts[i], cuts[i + 1], leaf) for i, leaf in enumerate(leaves)]
        while len(level) > 1:
            level = self._join_all(word, [(level[i], level[i + 1]) for i in range(0, len(level), 2)])
        return [i for i, _ in level[0][2]]

    def _join_all(self, word: str, pairs):
        """All joins of a level: the windows of those still open are encoded in one batch, then grow."""
        done: list = [None] * len(pairs)
        todo, k = list(range(len(pairs))), self.window
        while todo:
            asked = []
            for p in todo:
                (a, _, x), (_, b, y) = pairs[p]
                i, j = max(0, len(x) - k), min(len(y), k)
                asked.append((i, j, a + sum(w for _, w in x[:i]), b - sum(w for _, w in y[j:])))
            ends = asked[-1][3] == len(word)  # only the last pair can reach the word's end
            mids = self._pieces([word[at:to] for _, _, at, to in asked], ends)
            left = []
            for p, (i, j, _, _), mid in zip(todo, asked, mids, strict=True):
                (a, _, x), (_, b, y) = pairs[p]
                if (i == 0 or mid[0] == x[i]) and (j == len(y) or mid[-1] == y[j - 1]):
                    done[p] = a, b, x[:i] + mid + y[j:]
                else:
                    left.append(p)
            todo, k = left, 2 * k
        return done

    # --- units and texts ----------------------------------------------------------------------

    def encode_unit(self, unit: str) -> list[int]:
        """Ids of a run without ASCII white space."""
        if len(unit) <= self.leaf_word:
            return self.tok.encode(unit, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        for m in self._special_at.finditer(unit) if self._special_at else ():
            ids += self._plain(unit[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(unit[at:])

    def _plain(self, part: str) -> list[int]:
        if not part:
            return []
        ids: list[int] = []
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
            ids += self.encode_word(word)
        return ids

    def _known(self, part: str, latin: bool) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text) of a pre-token of Latin-1 text, or of a unit of any other."""
        ids = self.encode_word("".join([self._bytes[b] for b in part.encode()])) if latin else self.encode_unit(part)
        found = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(part) <= 64:
            memo = self.memo[latin]
            if len(memo) >= MEMO:
                memo.clear()
            memo[part] = found
        return found

    def _segments(self, text: str) -> list[str]:
        """The tree's leaves and joins in order: halves down to the leaf size; the window at each seam grows to white space on both sides."""
        n, parts = len(text), 1
        while n / parts > self.leaf_text:
            parts *= 2
        out: list[str] = []
        done = 0
        for i in range(1, parts):
            cut = n * i // parts
            if cut < done:
                continue
            low = max(done, *(text.rfind(c, done, cut) + 1 for c in " \t\n\r"))
            m = _SPACES.search(text, cut)
            high = m.start() if m else n
            out += (text[done:low], text[low:high])
            done = high
        out.append(text[done:])
        return [x for x in out if x]

    def _coded(self, text: str | None) -> list[tuple[int, str, str]]:
        """What ``_known`` gives for each string that the tokenizer encodes by itself, in order."""
        out: list[tuple[int, str, str]] = []
        for segment in self._segments(text or ""):
            latin = self.latin and not self._outside.search(segment) and not (self._special_at and self._special_at.search(segment))
            parts = self._latin.findall(segment.lower()) if latin else [u for u in _SPACES.split(segment) if u]
            known, slow = self.memo[latin].get, self._known
            out += [known(u) or slow(u, latin) for u in parts]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text (null: none)."""
        return [int(i) for g in self._coded(text) for i in g[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library does; without a decoder that is the tokens joined by blanks."""
        if self.tok.decoder is None:
            return " ".join([self.tokens[i] for i in ids])
        return self.tok.decode(ids, skip_special_tokens=False)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids as text, sha256 of the decoded text)."""
        got = [g for g in self._coded(text) if g[0]]
        ids = " ".join([g[1] for g in got])
        decoded = " ".join([g[2] for g in got])
        return sum(g[0] for g in got), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of each whole text (and, if named, the text they decode to). Null and empty texts have no ids."""

    def make():
        coder = TreeEncoder(path or tokenizer_path())

        def of(texts):
            found = [coder.encode(t) for t in texts]
            return (found, [coder.decode(i) for i in found]) if decoded else (found,)

        return of

    return add_columns(docs, [text], {ids: "array<bigint>"} | ({decoded: "string"} if decoded else {}), make)


def encode_digests(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text and drop the text."""

    def make():
        coder = TreeEncoder(path or tokenizer_path())

        def of(texts):
            got = [coder.digest(t) for t in texts]
            return tuple(map(list, zip(*got, strict=True)))

        return of

    return add_columns(docs, [text], {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make, drop=(text,))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoding and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
