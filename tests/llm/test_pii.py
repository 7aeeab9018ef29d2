"""Personal data: base patterns against the plain patterns, disclosure against brute force."""

import math
import random
import re
from collections import defaultdict

from powerlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "Z.", "@", "@b.c", "x@y-z.co", "1", "22", "255.", "256.", "007.", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+", "-", " ",
             "(", ")", ".", "é", "١", "\n", "%", "_", "+49.30.1234567", "378282246310005", "1.2.3.4"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)


def test_long_texts_take_linear_time():
    for unit in ("1", "1.", "a", "a@", "+1", "1 ", "+1(", "a.", "@a."):
        text = unit * 100_000
        pii.near_terms(text, pii.base_spans(text)[:50])


def plain_terms(texts):
    """Share of the entity's information by (entity, term), straight from the formula."""
    rows, has, occurs = [t or "" for t in texts], defaultdict(int), defaultdict(set)
    both, support = defaultdict(int), defaultdict(set)
    for k, t in enumerate(rows):
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            has[w] += 1
        near = pii.near_terms(t, pii.base_spans(t))
        for pair in {(n[0], n[2]) for n in near}:
            both[pair] += 1
            occurs[pair[0]].add(k)
        for n in near:
            support[n[0], n[2]].add(n[1])
    out = {}
    for (e, w), b in both.items():
        ic = math.log(len(rows) / len(occurs[e]))
        if len(support[e, w]) >= pii.LEAST_SUPPORT and ic > 0:
            out[e, w] = math.log(b * len(rows) / (has[w] * len(occurs[e]))) / ic
    return out


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdklm" for b in "aeiou" for c in "nrst"]
    texts = []
    for k in range(120):
        t = [rng.choice(words) for _ in range(30)]
        if k % 6 == 0:
            t[rng.randrange(5, 25)] = "Quentin mail anna.k@example.com now"
        if k % 15 == 0:
            t[rng.randrange(5, 25)] = "call +1 (555) 123-4567 Zanzibar"
        texts.append(" ".join(t))
    texts += [texts[0]] * 4 + [None, "", "plain words only", "zanzibar far away", "10.0.0.1", "card 4111 1111 1111 1111 end"]
    return texts


def test_disclosure_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(k % 125, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    share = plain_terms(texts)
    got = defaultdict(list)
    for r in pii.find(df).collect():
        got[r.doc_id].append(tuple(tuple(x) for x in r.spans))
    want = defaultdict(list)
    flagged = 0
    for k, t in enumerate(texts):
        base = plain_spans(t or "")
        terms = {}
        for e, _, w, s, end in pii.near_terms(t or "", base):
            if share.get((e, w), 0) >= pii.GENERALISE_AT:
                terms[s, end] = max(terms.get((s, end), 0), share[e, w])
        extra = [(s, end, "remove" if x >= pii.REMOVE_AT else "generalise") for (s, end), x in terms.items()]
        flagged += len(extra)
        rank = pii.KINDS + pii.TERM_KINDS
        want[k % 125].append(tuple((kind, s, e) for s, e, kind in sorted([*base, *extra], key=lambda x: (x[0], rank.index(x[2])))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert flagged >= 20  # Quentin and Zanzibar give their entities away


def test_sanitise(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, t, "d", "t") for k, t in enumerate(texts)], "doc_id long, text string, digest string, Terms string")
    out = pii.sanitise(df)
    assert out.columns == df.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        if not plain_spans(t or ""):
            assert rows[k].text == t
        else:
            assert not plain_spans(rows[k].text)
            assert "anna" not in rows[k].text and "Quentin" not in rows[k].text
    assert rows[len(texts) - 1].text == "card [CARD] end"
    assert rows[len(texts) - 2].text == "[IP]"
    assert pii.find(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def test_replaced_overlaps():
    assert pii.replaced("x +4111 1111 1111 111 y", []) in ("x [PHONE] y",)
    assert pii.replaced("a@b.c 1.2.3.4", [(0, 1, "generalise")]) == "[EMAIL] [IP]"


def test_rare_entities(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}{d}" for a in "bdklm" for b in "aeiou" for c in "nrst" for d in "aeiou"]

    def around(*middle):
        t = [rng.choice(words) for _ in range(40)]
        t[20:20] = middle
        return " ".join(t)

    texts = [around() for _ in range(3000)]
    texts[10] = around("Quentin", "anna.k@example.com")  # one address in two documents
    texts[20] = around("anna.k@example.com", "from", "Quentin")
    for k in range(4):  # numbers seen once each, of one owner
        texts[30 + k] = around("Zanzibar", f"+1 (555) 123-{4000 + k}")
    texts[40] = around("Alone", "10.0.0.1")
    near = around("bob@example.org", "Copied")
    texts[50], texts[51] = near, near.replace(" Copied", " Copied indeed")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for k in (10, 20):
        assert "Quentin" not in got[k] and "[EMAIL]" in got[k]
    for k in range(30, 34):
        assert "Zanzibar" not in got[k] and "[PHONE]" in got[k]
    assert got[40] == texts[40].replace("10.0.0.1", "[IP]")
    assert got[50] == texts[50].replace("bob@example.org", "[EMAIL]")
    assert all(got[k] == t for k, t in enumerate(texts) if not plain_spans(t))
