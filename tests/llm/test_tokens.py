"""Encoding, token attribution and language-model scores against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longpanel.llm import op1_sentencepiece, op6_token_counts, op8_lm_scoring

ODD = [None, "", " ", "   ", "▁", "a▁b", " ▁ a", "\n", "\t a  b ", "é漢字🙂", "a b", "　", "x" * 5000, "ﬁ ½ Å", "\x00 a", "<s> </s> <unk>", "a  b   c    d", "  lead", "trail  ", "\r\n\r\n"]


def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=op1_sentencepiece.default_model())


def random_texts(n, seed=5):
    rng = random.Random(seed)
    alphabet = "ab c  d\n\té漢▁🙂0<>.,-A'  "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_librarys(spark, sf_dir):
    p = processor()
    texts = ODD + random_texts(400) + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = op1_sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digest=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = p.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids, repr(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()


def test_decode(spark):
    texts = ["one two", "", "é漢字🙂"]
    df = op1_sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["decoded"] for r in op1_sentencepiece.decode(df).orderBy("doc_id").collect()] == texts
    with pytest.raises(ValueError, match="clash"):
        op1_sentencepiece.encode(df)


@pytest.mark.parametrize("rule", op6_token_counts.RULES)
def test_attribution_by_byte(spark, sf_dir, rule):
    """Against a walk over every byte of every token."""
    encoding, lengths = op6_token_counts._encoder(op6_token_counts.default_vocabulary())
    texts = [t or "" for t in ODD] + ["a\nb\n\nc", "\n\n\n", "x\r\ny  \n  z"]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    found = {r["doc_id"]: r for r in op6_token_counts.count_tokens(docs, rule).collect()}
    for i, text in enumerate(texts):
        data = text.encode()
        line_of, line = [], 0
        for b in data:
            line_of.append(line)
            line += b == 10
        counts, at, crossing = [0.0] * ((line_of[-1] + 1) if data else 0), 0, 0
        ids = encoding.encode_ordinary(text)
        for t in ids:
            lines = line_of[at : at + lengths[t]]
            at += lengths[t]
            share = Counter(lines)
            crossing += len(share) > 1
            if rule == "first":
                counts[lines[0]] += 1
            elif rule == "most":
                counts[max(share, key=lambda k: (share[k], -k))] += 1
            else:
                for k, c in share.items():
                    counts[k] += c / len(lines)
        assert at == len(data)
        r = found[i]
        assert (r["n_tokens"], r["n_sections"], r["n_crossing"]) == (len(ids), len(counts), crossing)
        assert r["section_tokens"] == pytest.approx(counts)
        assert sum(r["section_tokens"]) == pytest.approx(len(ids))


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def automaton(rows, train):
    """A plain backoff automaton of the training texts: counts, states, arcs and failure arcs."""
    n, texts = Counter(), 0
    for i, t in rows:
        if train(i):
            ws = [*WORDS.findall(lower(t)), None]
            texts += 1
            for k in range(len(ws)):
                n[ws[k],] += 1
                n[ws[k - 1] if k else "<s>", ws[k]] += 1
                if k:
                    n[ws[k - 2] if k > 1 else "<s>", ws[k - 1], ws[k]] += 1
    n["<s>",] = texts
    total, kinds = sum(c for g, c in n.items() if len(g) == 1) - texts, sum(len(g) == 1 for g in n) - (texts > 0)

    def arc(state, w):
        shorter = (n[w,] + 0.5) / (total + 0.5 * (kinds + 1)) if not state else None
        if shorter is not None:
            return shorter
        m = op8_lm_scoring.PRIORS[len(state) - 1]
        return (n[*state, w] + m * arc(state[1:], w)) / (n[state] + m)

    def walk(ws):
        state, score = ("<s>",), 0.0
        for w in ws:
            here = state
            while here and not n[*here, w]:  # failure arcs
                m = op8_lm_scoring.PRIORS[len(here) - 1]
                score += math.log10(m / (n[here] + m))
                here = here[1:]
            score += math.log10(arc(here, w))
            state = (*state, w)[-2:]
            while state and not n[state]:
                state = state[1:]
        return score

    return n, total, kinds, walk, arc


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 20_000])
def test_scores_against_a_plain_automaton(spark, sf_dir, monkeypatch, chunk_bytes):
    monkeypatch.setattr(op8_lm_scoring, "CHUNK_BYTES", chunk_bytes)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(90_001, None), (90_002, "a A a"), (90_003, ""), (None, "unheard of"), (90_002, "a A a"), (90_004, "word " * 30_000)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    n, total, kinds, walk, _ = automaton(rows, lambda i: not held(i))
    every = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, chunk int, row string")
    found = op8_lm_scoring.score(every).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted((i or 0, len(WORDS.findall(t or "")) + 1) for i, t in rows)
    got = {r["doc_id"]: r for r in found}
    for i, t in rows:
        ws, r = [*WORDS.findall(lower(t)), None], got[i]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held(i), sum(n[w,] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((n[w,] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), rel=1e-9)
        assert r["score"] == pytest.approx(walk(ws), rel=1e-9)
    # the model's longer contexts help on texts it has not learnt from
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_model_is_a_distribution():
    """From every state the probabilities of all words, known or not, sum to one."""
    rng = random.Random(3)
    n, total, kinds, _, arc = automaton([(i, " ".join(rng.choice("abcdef") for _ in range(12))) for i in range(60)], lambda i: True)
    words = [g[0] for g in n if len(g) == 1 and g[0] != "<s>"]
    for state in {g[:-1] for g in n} | {()}:
        assert sum(arc(state, w) for w in [*words, "unseen"]) == pytest.approx(1)


@pytest.mark.parametrize("squeeze", [False, True])
def test_packed_numbers(squeeze):
    for a in ([0, 1, 255, 256, 2**63, 2**64 - 1], [0, 0], [7], []):
        a = np.array(a, np.uint64)
        assert (op8_lm_scoring.unpack(op8_lm_scoring.pack(a, squeeze), squeeze) == a).all()
