"""Nothing that an operator's own rules accept is left out on the way to them."""

import random

import numpy as np

from tracelens.llm import decontam, toxicity


def fitted(items, texts):
    m = decontam.Model(list(enumerate(items)))
    w = decontam.Words(texts)
    t = m.lookup.of(w)
    both = np.unique(w.doc[t >= 0] * len(m.vocab) + t[t >= 0])
    m.weigh(np.bincount(both % len(m.vocab), minlength=len(m.vocab)), len(texts))
    a = np.zeros((len(texts), decontam.DIMS))
    np.add.at(a, (w.doc[t >= 0], m.bucket[t[t >= 0]]), (m.idf * m.sign)[t[t >= 0]])
    m.project(a.T @ (a @ m.omega))
    return decontam.Scanner(m, dict(enumerate(items)))


def accepted(s, item, text):
    """Step 4 at every stride, without candidates."""
    ws, rare, words = s.m.items[item][1], s.m.rare[item], decontam.tokens(text)
    for at in range(0, len(words), decontam.STRIDE):
        x = words[max(0, at - decontam.STRIDE) : at + (decontam.FIT + 1) * decontam.STRIDE]
        share, kept = decontam.lcs_length(ws, x) / len(ws), decontam.lcs_length(rare, [w for w in x if w in set(rare)]) / max(1, len(rare))
        if share >= decontam.SURE or min(share, kept) >= decontam.LCS or (min(share, kept) >= decontam.PARA and decontam.in_order(s.answers[item], x)):
            return True
    return False


def test_no_accepted_passage_is_lost():
    rng = random.Random(9)
    vocab = sorted({"".join(rng.choice(["an", "er", "to", "li", "ma", "so", "ke", "ru"]) for _ in range(rng.randint(1, 4))) for _ in range(900)})
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [prose(n) for n in (15, 15, 20, 20, 30, 40, 59, 150)] + [["the"] * 9]
    texts, want = [], set()
    for i, item in enumerate(items):
        for k in range(40):
            keep = (1, 0.85, 0.75, 0.65)[k % 4]
            edited = [x if j >= len(item) - 6 or rng.random() < keep else rng.choice(vocab) for j, x in enumerate(item)]
            # on either side another item's word, repeated, which outweighs a short passage in any window
            other = [items[(i + 1) % 8][0]] * (40 * (k % 2))
            texts.append(" ".join([*prose(rng.randrange(60)), *other, *edited, *other, *prose(rng.randrange(60))]))
    texts += [" ".join(prose(90)) for _ in range(300)] + ["", None]
    s = fitted([" ".join(x) for x in items], texts)
    for d, t in enumerate(texts):
        want |= {(d, i) for n, (i, _) in enumerate(s.m.items) if accepted(s, n, t)}
    assert {(h[0], h[1]) for h in s(decontam.Words(texts))} == want
    assert len(want) > 250


def test_words_are_decoded_whole():
    vocab = ["worthless", "stupid", "you", "are", "the", "house", "of", "green", "people", "and", "water"]
    rng = random.Random(2)
    counts = np.zeros(toxicity.SIZE**3, np.int64)
    code = [toxicity._CODE.get(c, 0) for c in " ".join(rng.choice(vocab) for _ in range(5000))]
    np.add.at(counts, [(a * 64 + b) * 64 + c for a, b, c in zip(code, code[1:], code[2:])], 1)
    r = toxicity.Restorer(toxicity.Channel(counts))
    read = lambda t: [x for w in r(t) for x in r.readings(w)]
    assert [r.word(w) for w in ("w0r7h1355", "5.t.u.p.1.d", "st" + "u" * 45 + "pid", "s" + "." * 60 + "tupid", "2024", "3,000.50")] == ["worthless", "stupid", "stupid", "stupid", "2024", "3,000.50"]
    assert read("y o u s t u p i d") == ["youstupid", "you stupid"] and read("s  t  u  p  i  d") == ["stupid"]
    assert read("y o u  s t u p i d") == ["you", "stupid"] and read("a s t u p i d 1 2 3")[0].startswith("astupid")
