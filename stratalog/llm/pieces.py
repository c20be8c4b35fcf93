"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs, best score first and leftmost on ties, and
merges until no pair is a piece; what is no piece is written as its bytes. Texts are cut where
no piece of the vocabulary reaches over (found when it is loaded: before spaces, beside marks), and the ids of short cuts are remembered within a Python worker.
In each Arrow batch every cut that was not met before goes through the sentencepiece library too;
where the library answers differently its answer is taken and the row's agrees is false. All ids
are decoded by the library's decode; MergeVocabulary.decode is the same without it.

Defined cases: a null text counts as empty; repeated rows are encoded each; an empty table gives
an empty table; other columns are passed over.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
REMEMBERED = 250_000  # cuts in each of a worker's two memories
SHORT = 48  # characters of a cut that is remembered
ROWS = 64  # rows decoded by the library at a time


class MergeVocabulary:
    """The pieces of a model file's bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if len(byte_ids) != 256 or any(sp.is_unused(i) for i in normal):
            raise ValueError("a vocabulary with byte fallback and without unused pieces is needed")
        if sp.normalize("  a  b ") != f"{SPACE * 3}a{SPACE * 2}b{SPACE}":
            raise ValueError("a vocabulary that keeps white space and adds one space in front is needed")
        self.ids = {pieces[i]: i for i in normal}
        self.cost = {pieces[i]: -sp.get_score(i) for i in normal}
        packed = [i.to_bytes(4, "little") for i in range(n)]
        if "\n" in "".join(self.ids):
            raise ValueError("a vocabulary without line feeds inside pieces is needed")
        self.packed = {pieces[i]: packed[i] for i in normal}
        self.byte_packed = [packed[i] for i in byte_ids]
        self.bos, self.eos = packed[sp.bos_id()], packed[sp.eos_id()]
        self.cuts = re.compile(self._cut_pattern())
        self.text_of = [b"" if sp.is_control(i) else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        if sp.unk_id() >= 0:
            self.text_of[sp.unk_id()] = " ⁇ ".encode()
        for value, i in enumerate(byte_ids):
            self.text_of[i] = bytes([value])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; what is used of it becomes known again

    def _cut_pattern(self) -> str:
        """Places that no piece reaches over: before a run of space marks, and between marks and letters.

        Marks stand beside no letter in any piece; where a character is neither (like a raised 2), nothing is cut.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return "(?s).+"
        pairs = {x for p in self.ids for x in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:])}
        other = {c for p in self.ids for c in p if not (c.isalpha() or c.isdecimal()) and c != SPACE}
        glue = {c for c in other if c.isalnum()}
        glue |= {c for pair in pairs for c in pair if c in other and not other.issuperset(pair)}
        marks, glue = ("".join(map(re.escape, sorted(x))) or "\\n" for x in (other - glue, glue))
        return f"{SPACE}*[^{SPACE}{marks}{glue}]+(?=[{SPACE}{marks}]|$)|{SPACE}*[{marks}]++(?![{glue}])|{SPACE}+[^{SPACE}]*|[^{SPACE}]+"

    def merge(self, cut: str) -> bytes:
        """Ids of a normalised cut, four bytes each."""
        cost = self.cost
        symbols = list(cut)
        n = len(symbols)
        agenda = []
        a = symbols[0]
        for i in range(1, n):
            b = symbols[i]
            pair = a + b
            if pair in cost:
                agenda.append((cost[pair], i - 1, i, a, b, pair))
            a = b
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapq.heapify(agenda)
            push, pop = heapq.heappush, heapq.heappop
        while agenda:
            _, i, j, a, b, pair = pop(agenda)
            if symbols[i] is not a or symbols[j] is not b:
                continue  # one side has been merged since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                b = symbols[k]
                new = pair + b
                if new in cost:
                    push(agenda, (cost[new], i, k, pair, b, new))
            h = before[i]
            if h >= 0:
                a = symbols[h]
                new = a + pair
                if new in cost:
                    push(agenda, (cost[new], h, i, a, pair, new))
        packed, as_bytes = self.packed, self.byte_packed
        return b"".join([packed[s] if s in packed else b"".join([as_bytes[x] for x in s.encode()]) for s in symbols if s])

    def checked(self, cuts: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of cuts, and those cuts on which the library differed."""
        own = {c: self.merge(c) for c in cuts}
        # the library puts a space in front; a line feed, a byte of its own, parts it from the cut
        theirs = self.library.encode(["\n" + c.replace(SPACE, " ") for c in cuts], num_threads=1)
        wrong = set()
        for c, ids in zip(cuts, theirs, strict=True):
            if own[c] != (them := b"".join([i.to_bytes(4, "little") for i in ids[2:]])):
                own[c] = them
                wrong.add(c)
        return own, wrong

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.text_of.__getitem__, ids))
        return out[out[:1] == b" " :].decode("utf-8", "replace")


def _encode(vocabulary: MergeVocabulary, texts: list[str], add_bos: bool, add_eos: bool) -> Iterator[tuple[bytes, bool]]:
    find = vocabulary.cuts.findall
    for at in range(0, len(texts), ROWS):
        known, older = vocabulary.known, vocabulary.older
        cut_up = [find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[at : at + ROWS]]
        missing = {c for cuts in cut_up for c in cuts if c not in known}
        ids = {c: older[c] for c in missing if c in older}
        wrong: set[str] = set()
        if new := list(missing.difference(ids)):
            fresh, wrong = vocabulary.checked(new)
            ids |= fresh
        known.update(ids)
        for cuts in cut_up:
            body = b"".join(map(known.__getitem__, cuts))
            yield (vocabulary.bos if add_bos else b"") + body + (vocabulary.eos if add_eos else b""), not wrong or wrong.isdisjoint(cuts)
        for c in [c for c in ids if len(c) > SHORT or c in wrong]:
            del known[c]
        if len(known) > REMEMBERED:
            vocabulary.known, vocabulary.older = {}, known


def encode_documents(docs: DataFrame, model_path: str, *, add_bos: bool = True, add_eos: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded, agrees for each row of docs (doc_id, text)."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        vocabulary = MergeVocabulary(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * ROWS):
                part = batch.slice(at, 4 * ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                packed, decoded, agrees = [], [], []
                for ids, same in _encode(vocabulary, texts, add_bos, add_eos):
                    packed.append(ids)
                    agrees.append(same)
                for k in range(0, len(packed), ROWS):
                    decoded += vocabulary.library.decode([array.array("I", x).tolist() for x in packed[k : k + ROWS]], num_threads=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["doc_id", "ids", "decoded", "agrees"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string, agrees boolean")
