"""Alignment of two tokenizers against whole texts encoded by the vocabulary files' own libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lanewise.llm.token_alignment import Aligner, align

DOCS = "doc_id long, text string, lang string, n long, digest string, chunk long"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
# the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in OWN} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in OWN)}


def groups_of(text):
    """The groups (ids of A, ids of B) of a text, or none."""
    if not text:
        return []
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    out, done_a, done_b, j = [([], [])], 0, 0, 0
    for i, x in a:
        done_a += len(x)
        out[-1][0].append(i)
        while j < len(b) and done_b + len(b[j][1]) <= done_a:
            done_b += len(b[j][1])
            out[-1][1].append(b[j][0])
            j += 1
        if done_a == done_b and done_a < len(raw):
            out.append(([], []))
    return out


def brute(docs):
    known = [groups_of(t) for _, t, *_ in docs]
    links = [Counter((a, b) for g in k for a in g[0] for b in g[1]) for k in known]
    count = Counter(p for x in links for p in x)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (i, *_), k, x in zip(docs, known, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in k)
        out.append((i, sum(len(a) for a, _ in k), sum(len(b) for _, b in k), len(k), sum(x.values()), sum(n for p, n in x.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if k else ""))
    return sorted(out, key=str)


def texts_of(seed, n):
    rng = random.Random(seed)
    bits = ["a", "the ", " and", "\n", "  ", "\t", "\x1c", "\xa0", "　", "é", "ß", "日本", "\U0001f600", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "0", "1234", "'s", "\r\n", "\x00", "ﬁ", "é", ".", "...", "x" * 9, "\x85", " ", "Ħ", "​", "ing "]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_documents_match_whole_texts(spark):
    texts = texts_of(1, 150) + [None, "", " ", "\n", "\n \n", "a b", "a b", " a b ", "has ▁ mark", "ab " * 5000, "z" * 20_000, "the cat sat", "The cat sat"]
    docs = [(k * 3, t, None, k, "d", 1) for k, t in enumerate(texts)] + [(5, "a b", "x", 0, "", 0), (5, "a b", "x", 0, "", 0), (None, "the cat sat", None, None, None, None), (None, None, None, None, None, None)]
    got = sorted((tuple(r) for r in align(spark.createDataFrame(docs, DOCS)).collect()), key=str)
    assert got == brute(docs)


def test_a_text_held_by_most_documents(spark):
    docs = [(k, "one text for all", "", 0, "", 0) for k in range(3000)] + [(k, f"another text {k}", "", 0, "", 0) for k in range(3000, 3300)]
    got = sorted((tuple(r) for r in align(spark.createDataFrame(docs, DOCS)).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], DOCS)).collect() == []


def test_segments_are_remembered_and_forgotten(monkeypatch):
    import lanewise.llm.token_alignment as m

    monkeypatch.setattr(m, "REMEMBERED", 3)
    aligner = Aligner()
    for text in texts_of(2, 60):
        if "▁" not in text:
            row = aligner.chunk([text], [1]).to_pylist()[0]
            k = groups_of(text)
            assert (row["n_a"], row["n_b"], row["n_groups"]) == ([sum(len(a) for a, _ in k)], [sum(len(b) for _, b in k)], [len(k)])
