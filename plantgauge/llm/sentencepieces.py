"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text becomes marked words (a space becomes the word mark, runs of marks stay
with the word they open). The distinct words of a block, sorted, are the leaves
of a trie; one depth-first walk over it keeps the forward states of the current
path, so words with a common prefix share the work on it.

Two kinds of model: ``unigram`` keeps the best score per position. ``bpe`` keeps
the one last token that byte-pair merging gives the prefix: a token may follow
another only if merging their joined text gives just these two back, any other
pair scores minus infinity, and exactly one path survives. Results equal the
library's for models without normalisation.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from plantgauge.llm.common import in_arrow, keeps_names, whole_text

MARK = "▁"
# words encoded so far that a worker process keeps
MEMO_WORDS = 400_000


def default_model() -> str:
    """The installed public piece model."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: sp.get_score(i) for i in normal}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.bpe = all(float(s).is_integer() for s in self.score.values())
        self.longest = max(map(len, self.id))
        self.dummy_prefix = sp.encode("a") != sp.encode(" a") or sp.encode("a") == [self.id.get(MARK + "a")]
        # cuts that no piece crosses
        self.cut_before_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.cut_at_newline = not any("\n" in p and len(p) > 1 for p in self.id)

    @functools.cached_property
    def _before(self) -> dict[str, dict[str, bool]]:
        """Of each piece: the tokens before it tried so far."""
        return {p: {} for p in self.id}

    @functools.cached_property
    def _tokens(self) -> dict[str, bytes]:
        """Ids of each piece and of the other characters met so far as 32-bit integers."""
        return {p: array("i", [i]).tobytes() for p, i in self.id.items()}

    @functools.cached_property
    def _odd(self) -> set[str]:
        """The characters met so far whose ids do not spell them; those of a piece do."""
        return set()

    @functools.cached_property
    def _steps(self) -> dict[str, list[tuple[float, str, str]]]:
        """Of each token met so far: :meth:`steps`."""
        return {}

    @functools.cached_property
    def _sizes(self) -> tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]:
        """Lengths above one of the pieces that end in three characters, and in two if no
        longer one ends in the three, longest first."""
        two: dict[str, set[int]] = {}
        three: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 1:
                two.setdefault(p[-2:], set()).update({2} if len(p) == 2 else ())
            if len(p) > 2:
                three.setdefault(p[-3:], set()).add(len(p))
        for end, sizes in three.items():
            sizes |= two[end[1:]]
        return tuple({end: tuple(sorted(sizes, reverse=True)) for end, sizes in ends.items()} for ends in (three, two))

    def fallback(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary."""
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8")]

    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: best score first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def steps(self, token: str) -> list[tuple[float, str, str]]:
        """(score of the next merge, first part, last part) before each merge of a token's
        characters and after the last, whose next score is minus infinity."""
        out = self._steps.get(token)
        if out is None:
            parts, out = list(token), []
            while True:
                best, at = float("-inf"), -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and s > best:
                        best, at = s, i
                out.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._steps[token] = out
        return out

    def follows(self, left: str, right: str) -> bool:
        """Whether merging leaves the border between two tokens.

        Until a merge crosses the border each side merges as if alone, the better score first.
        """
        known = self._before[right].get(left)
        if known is None:
            b = self.steps(right)
            known = b[-1][1] == right
            if known and left:
                a, score = self.steps(left), self.score
                known = a[-1][2] == left
                i = j = 0
                while known:
                    (x, _, end), (y, begin, _) = a[i], b[j]
                    across = score.get(end + begin)
                    # of equal scores the leftmost merge comes first
                    if across is not None and across > x and across >= y:
                        known = False
                    elif x >= y:
                        if i == len(a) - 1:
                            break
                        i += 1
                    else:
                        j += 1
            self._before[right][left] = known
        return known

    def words(self, text: str) -> list[str]:
        """Marked words whose encodings join to the text's."""
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.cut_before_mark:
            return [marked]
        if self.cut_at_newline:
            return re.findall(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+", marked)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)

    def token(self, char: str) -> bytes:
        """The ids of a character outside the vocabulary as 32-bit integers."""
        ids = self.fallback(char)
        if self.spell(ids) != char.replace(MARK, " "):
            self._odd.add(char)
        self._tokens[char] = array("i", ids).tobytes()
        return self._tokens[char]

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        return {w: np.frombuffer(ids, dtype=np.int32).tolist() for w, (ids, _) in self.encoded(words)}

    def encoded(self, words):
        """(word, (ids as 32-bit integers, whether all tokens come back)) of each distinct word, by a
        depth-first walk over their sorted trie."""
        # of the prefix of each length: best score and last token
        scores: list[float] = [0.0]
        last: list[str] = [""]
        path = ""
        score, longest, bpe, before, tokens, odd = self.score, self.longest, self.bpe, self._before, self._tokens, self._odd
        three, two = self._sizes
        for word in sorted(words):
            keep = 0
            top = min(len(path), len(word))
            while keep < top and path[keep] == word[keep]:
                keep += 1
            del scores[keep + 1 :], last[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                # if no longer piece may come last, the one path goes through the character
                token = word[i - 1]
                if bpe:
                    sizes = three.get(word[i - 3 : i]) if i > 2 else None
                    if sizes is None:
                        sizes = two.get(word[i - 2 : i], ()) if i > 1 else ()
                    for size in sizes:
                        if size > i:
                            continue
                        part = word[i - size : i]
                        tried = before.get(part)
                        if tried is not None:
                            left = last[i - size]
                            known = tried.get(left)
                            if known is None:
                                known = self.follows(left, part)
                            if known:
                                token = part
                                break
                else:
                    best = None
                    for j in range(max(0, i - longest), i):
                        s = score.get(word[j:i])
                        if s is not None and (best is None or scores[j] + s > best):
                            best, token = scores[j] + s, word[j:i]
                    if best is None:
                        best = scores[i - 1] - 1e3
                    scores.append(best)
                last.append(token)
            path = word
            i, held = len(word), []
            while i:
                token = last[i]
                held.append(token)
                i -= len(token)
            held.reverse()
            try:
                ids = b"".join([tokens[t] for t in held])
            except KeyError:
                ids = b"".join([tokens.get(t) or self.token(t) for t in held])
            yield word, (ids, not odd or odd.isdisjoint(held))

    @functools.cached_property
    def _spelt(self) -> pa.Array:
        """The bytes of each id, then those of each id as the first of a text."""
        spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.text)]
        return pa.array(spelt + [s.removeprefix(b" ") if self.dummy_prefix else s for s in spelt], pa.large_binary())

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """:meth:`decode` of every list of ids, null as no ids: the bytes of all tokens are gathered at
        once. Texts whose bytes are not in order are spelt one by one."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.text):
            raise IndexError("token id outside the vocabulary")
        ids[cuts[:-1][sizes > 0]] += len(self.text)
        ends = np.concatenate([[0], np.cumsum(self._lengths[ids])])[cuts]
        whole = self._spelt.take(pa.array(ids)).buffers()[2] or pa.py_buffer(b"")
        out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), whole])
        try:
            if MARK.encode() not in whole.to_pybytes():
                return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            pass
        ids[cuts[:-1][sizes > 0]] -= len(self.text)
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])], pa.string())

    @functools.cached_property
    def _lengths(self) -> np.ndarray:
        return pc.binary_length(self._spelt).to_numpy()

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no text become U+FFFD."""
        out = self.spell(ids)
        return out[1:] if self.dummy_prefix and out[:1] == " " else out

    def spell(self, ids) -> str:
        """The text of token ids with the space of the first word mark."""
        parts, held = [], bytearray()
        byte_of, text = self.byte_of, self.text
        for t in ids:
            b = byte_of.get(t)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(text[t])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")


_LOADED: dict[str, Pieces] = {}
_ENCODED: dict[str, dict[str, bytes]] = {}
_MISSPELT: dict[str, set[str]] = {}


def pieces(path: str) -> Pieces:
    """The model of a file, read once per process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_texts(model: Pieces, texts, memo: dict[str, bytes], misspelt: set[str]) -> tuple[list[bytes], list[bool]]:
    """Token ids of each text as 32-bit integers, and whether its tokens spell it. ``memo``
    keeps words already encoded, and ``misspelt`` those with a token that does not come back.
    The flags foretell what decoding gives; :func:`encode_documents` decodes the ids instead."""
    cut = [model.words(t) for t in texts]
    every = set().union(*cut)
    new = every - memo.keys()
    if len(memo) + len(new) > MEMO_WORDS:
        # the words met again are the frequent ones
        met = {w: memo[w] for w in every - new}
        memo.clear()
        memo.update(met)
        misspelt.intersection_update(met)
    for w, (ids, back) in model.encoded(new):
        memo[w] = ids
        if not back:
            misspelt.add(w)
    out = [b"".join(map(memo.__getitem__, ws)) for ws in cut]
    return out, [misspelt.isdisjoint(ws) for ws in cut] if misspelt else [True] * len(cut)


@keeps_names("_s_")
def encode_documents(df: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids`` (array<int>), ``n_tokens`` (long) and
    ``round_trip`` (boolean: decoding gives the text back, word marks in the text
    read as spaces).

    The ids of every row are decoded by :func:`decode_documents` and compared with its text;
    Spark leaves that out where ``round_trip`` is not asked for. Null and empty texts have no
    tokens and round-trip. Rows are independent and no row moves; a worker holds one block of
    texts and at most ``MEMO_WORDS`` words. Columns of these names are replaced.
    """
    path = model_path or default_model()
    rows = df.drop("token_ids", "n_tokens", "round_trip")
    names = rows.columns
    rows = rows.withColumn("_s_text", whole_text(text))
    schema = T.StructType(rows.schema.fields + T._parse_datatype_string("token_ids array<int>, n_tokens long").fields)

    def encode(batches):
        model, memo, misspelt = pieces(path), _ENCODED.setdefault(path, {}), _MISSPELT.setdefault(path, set())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids, _ = encode_texts(model, texts, memo, misspelt)
                sizes = [len(x) // 4 for x in ids]
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    batch.columns + [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes, pa.int64())], names=schema.names
                )

    out = decode_documents(in_arrow(rows, encode, schema), path, out="_s_back")
    back = F.col("_s_back") == F.replace("_s_text", F.lit(MARK), F.lit(" "))
    return out.select(*[F.col(f"`{c}`") for c in names], "token_ids", "n_tokens", back.alias("round_trip"))


def decode_documents(df: DataFrame, model_path: str | None = None, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """``df`` with the text of its token ids (column ``out``, replaced if there); null and empty
    ids give the empty text, repeated rows equal texts, an empty table stays empty."""
    path = model_path or default_model()

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return pieces(path).decode_all(lists)

    return df.withColumn(out, decode(F.col(ids)))
