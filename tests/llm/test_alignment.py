"""Operator 11 against a plain version over whole texts, and on awkward rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seriesloom.llm import alignment
from tests.llm.helpers import rows_of


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = dict(zip(map(chr, plain), plain))
    stand_in |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def decoded_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        """Whole texts, one call per side: (id, end in bytes) of every token, or nothing."""
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        sides = []
        for ids, decode in (
            (ids_a, lambda i: bytes(stand_in[c] for c in a.id_to_token(i))),
            (ids_b, decoded_b),
        ):
            parts = [decode(i) for i in ids]
            if b"".join(parts) != (" " + text).encode():
                return [], []
            sides.append(list(zip(ids, np.cumsum([len(p) for p in parts]).tolist())))
        return tuple(sides)

    return tokens


def _expected(rows, tokens):
    """Rows of the contract, by walking both lists of each whole text."""
    links, groups, sizes = [], [], []
    for _, text in rows:
        a, b = tokens(text)
        both = {e for _, e in a} & {e for _, e in b}
        links.append([(i, j) for i, e in a for j, f in b if e == f] if len(a) < 3000 else [
            (i, j) for (i, _), (j, _) in zip([x for x in a if x[1] in both], [x for x in b if x[1] in both])
        ])
        shown, last = [], 0
        for end in sorted(both):
            left = ",".join(str(i) for i, e in a if last < e <= end) if len(a) < 3000 else None
            right = ",".join(str(j) for j, e in b if last < e <= end) if len(a) < 3000 else None
            shown.append((left, right))
            last = end
        sizes.append((len(a), len(b), len(both)))
        groups.append(";".join(f"{x}|{y}" for x, y in shown) if len(a) < 3000 else None)
    count = Counter(p for row in links for p in row)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    want = []
    for (doc_id, _), row, (n_a, n_b, n_groups), shown in zip(rows, links, sizes, groups):
        digest = None if shown is None else hashlib.sha256(shown.encode()).hexdigest() if n_a else ""
        want.append((
            doc_id, n_a, n_b, n_groups, len(row),
            sum(count[p] == best[p[1]] for p in row), sum(count[p] for p in row), digest,
        ))
    return want


def test_equals_plain_version(docs, none, sample, spark, libraries):
    tricky = [
        "  two leading", "trailing  ", "a▁b", "▁", "x   y z", "tab\t tab \t", "\r\n\r\n x",
        "👩‍👩‍👧 日本 語 한국어", "\x00 \x01 \x7f", "<s> </s> <unk> <|endoftext|>", "é é", "a  b   c    d",
        " ", "\n", "<0x41> <0x0A>", "ﬁ ½ Å", "\x1c a\x1c b \x85 c  d", "'s it's 's", "a b " * 50,
    ]
    more = spark.createDataFrame(
        [(400 + i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string"
    )
    table = docs.select("doc_id", "text").unionByName(more)
    table = table.unionByName(sample[0].select("doc_id", "text").where("n_chars < 4000"))
    rows = [tuple(r) for r in table.collect()]
    want = _expected(rows, libraries)
    got = rows_of(alignment.aligned(table.repartition(5)))
    long = {w[0] for w in want if w[-1] is None}
    strip = lambda r: r if r[0] not in long else r[:-1]
    assert Counter(strip(r) for r in got) == Counter(strip(r) for r in want)
    assert sum(r[1] == 0 for r in got) == 4
    assert alignment.aligned(none).count() == 0


def test_groups_cover_the_text(docs, libraries):
    for r in alignment.alignments(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        a, b = libraries(r["text"])
        assert [i for i, _ in a] == r["a_ids"] and [j for j, _ in b] == r["b_ids"]
        assert sum(r["a_sizes"]) == len(a) and sum(r["b_sizes"]) == len(b)
        assert r["ends"] == sorted({e for _, e in a} & {e for _, e in b})


def test_result_does_not_depend_on_blocks(docs, monkeypatch):
    whole = Counter(rows_of(alignment.aligned(docs.repartition(1))))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 200)
    assert Counter(rows_of(alignment.aligned(docs.repartition(3)))) == whole


def test_pieces_with_inner_spaces_are_refused():
    with pytest.raises(ValueError):
        alignment._checked(["▁▁a", "a▁b"])
