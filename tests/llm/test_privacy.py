"""Rules against regular expressions, the field against enumeration, spans and redaction."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from lectern.llm import privacy as pv
from lectern.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def texts():
    random.seed(2)
    parts = ["a", "B.", "@", "x@y.z", "é", "1", "22", "255", "256", ".", "-", " ", "+", "+4", "(", ")", "_", "4539148803436467", "4539 1488", "\n", "%", "😀", "00"]
    out = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(4000)]
    return [*out, None, "", "ü 4539-1488-0343-6467, +1 (168) 555-5254; a.b@c.de 1.2.3.4.5.6.7.8", "a@b.c_d@e.f.g", "a@b@c.d"]


def test_rules_equal_the_patterns():
    field = pv.default_field()
    rows = texts()
    for text, (base, every) in zip(rows, pv.find(field, pa.array(rows)), strict=True):
        assert base == plain(text)
        assert set(base) <= set(every) and every == sorted(every, key=lambda x: (pv.KINDS.index(x[0]), x[1]))


def test_long_runs_take_time_in_proportion():
    n = 1_000_000
    for text in ("a" * n + "@", "1" * n, "+1" + " " * n, "@" * n, "+" * n):
        assert pv.base_spans(text) == []


def test_method_adds_what_the_rules_miss():
    rows = ["call (555) 123-4567 now", "é mail anna (at) mail.example.com please", "x 555-123-4567", "on 2024-05-17 at 12:30", "no 4785380592391138 there"]
    found = [[rows[i][a:b] for _, a, b in every] for i, (_, every) in enumerate(pv.find(pv.default_field(), pa.array(rows)))]
    assert found == [["(555) 123-4567"], ["anna (at) mail.example.com"], ["555-123-4567"], [], []]


def test_field_equals_enumeration(monkeypatch):
    field = pv.Field(pv.labelled_lines()[:12])
    rng = np.random.default_rng(0)
    n = len(pv.LABELS)
    firsts = np.array([0, 3, 4, 7])
    scores = rng.normal(size=(7, n))
    got = field.decode(scores, firsts)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        score = lambda p, a=a: scores[a + np.arange(len(p)), list(p)].sum() + field.pairs[n, p[0]] + sum(field.pairs[x, y] for x, y in itertools.pairwise(p))
        assert tuple(got[a:b]) == max(itertools.product(range(n), repeat=int(b - a)), key=score)
    pairs = rng.normal(size=(n + 1, n))
    one = rng.normal(size=(1, 3, n))
    marginal, expected = pv._forward_backward(one, pairs, np.array([[True, True, False]]))
    joint = np.exp(one[0, 0][:, None] + one[0, 1][None] + pairs[n][:, None] + pairs[:n])
    joint /= joint.sum()
    assert np.allclose(marginal[0, 0], joint.sum(1)) and np.allclose(marginal[0, 1], joint.sum(0))
    assert np.allclose(expected[:n], joint) and not marginal[0, 2].any()


def test_labelled_table_is_learnt():
    field = pv.default_field()
    lines = pv.labelled_lines()
    right = 0
    for words, labels in lines:
        before, own, after = field.parts(field.rows(words))
        own = own.copy()
        own[1:] += before[:-1]
        own[:-1] += after[1:]
        right += [pv.LABELS[i] for i in field.decode(own, np.array([0, len(words)]))] == labels
    assert right >= 0.97 * len(lines)


def test_tables(spark):
    rows = [(1, "mail a@b.de now +1 (168) 555-5254", 9, 1), (1, "mail a@b.de now +1 (168) 555-5254", 9, 1), (2, None, 0, 2), (None, "(555) 123-4567", 1, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base int")
    found = pv.spans(docs).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.spans)) for r in found) == [("1", 2, 2), ("1", 2, 2), ("2", 0, 0), ("None", 0, 1)]
    clean = pv.redact(docs)
    assert clean.schema == docs.schema
    assert sorted((str(r.text), str(r.n_chars)) for r in clean.collect()) == sorted(
        [("mail [EMAIL] now [PHONE]", "24")] * 2 + [("None", "None"), ("[PHONE]", "7")]
    )
    assert pv.spans(docs.limit(0)).count() == 0 and pv.redact(docs.limit(0)).count() == 0


def test_registered(spark):
    d = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op4_privacy"](spark, d).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in plain(text[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in base) for k in PATTERNS)


def test_spelled_addresses_are_whole():
    spelled = (
        "anna at mail.example.com", "anna (at) mail (dot) example (dot) com", "j.doe [AT] host [dot] site [dot] example [dot] org",
        "max at mail dot example dot com", "info(at)site(dot)example(dot)de",
    )
    rows = [f"please write to {x} or not" for x in spelled]
    rows += ["we sat at home and looked at the dot on it", "theater.example.com is a word", "a text that ends with (", "at the start"]
    found = [[rows[i][a:b] for _, a, b in every] for i, (_, every) in enumerate(pv.find(pv.default_field(), pa.array(rows)))]
    assert found == [[x] for x in spelled] + [[]] * 4


def test_memory_of_a_batch_is_bounded():
    """An Arrow batch holds 10,000 texts, of any length: what the search holds follows slices of it."""
    text = "some plain words of prose and a number 17 or so, mail bob@example.com now. " * 30
    batch = pa.record_batch([pa.array([text] * 10_000, pa.large_string())], names=["text"])
    field = pv.default_field()
    tracemalloc.start()
    n = sum(len(found) for found in pv._run(field, ["text"], lambda part, found: found)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 10_000 and batch.nbytes > 20 << 20 and peak < 150 << 20
