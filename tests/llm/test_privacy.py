"""Patterns against Python's regular expressions, and disclosing terms on a planted corpus."""

import random
import re
from hashlib import sha256

from pulse.llm import privacy

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return sorted(found)


def joined(spans):
    return ",".join(f"{kind}:{start}:{stop}" for start, _, kind, stop in spans)


def check(docs, rows):
    """Base columns, and that the base spans are among all spans."""
    result = privacy.privacy_query(docs).collect()
    assert all(set(joined(brute(dict(rows)[r["doc_id"]])).split(",")) <= {*r["spans"].split(","), ""}
               for r in result if r["doc_id"] is not None)
    got = sorted((tuple(r)[:6] for r in result), key=str)
    wanted = []
    for key, text in rows:
        spans = brute(text)
        wanted.append((key, *[sum(s[2] == k for s in spans) for k in PATTERNS],
                       sha256(joined(spans).encode()).hexdigest()))
    assert got == sorted(wanted, key=str)


def test_base_spans_match_on_random_text(make_docs):
    rng = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5", "4539 1488 0343 6467", "4539148803436467",
             "+1 (415) 555-0100", "+12", "+1-2", "é🙂", " ", "-", ".", "_", "%", "7", "12345678901234567890", "\n",
             "me@mail.example.com_you@b.c.d", "(", ")"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(400)]
    check(make_docs(rows), rows)


def test_awkward_rows(make_docs, awkward):
    rows = [*awkward, (20, "9" * 30_000), (21, "a" * 30_000 + "@b"), (22, "a@b" + ".c" * 10_000), (23, "1 " * 20_000)]
    check(make_docs(rows), rows)
    docs = make_docs(awkward)
    clean = privacy.without_personal_data(docs)
    assert clean.columns == docs.columns
    assert sorted((tuple(r) for r in clean.collect()), key=str) == sorted((tuple(r) for r in docs.collect()), key=str)
    assert privacy.privacy_query(make_docs([])).count() == 0


def test_disclosing_terms_are_found_and_common_ones_left(make_docs):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(300):
        line = [rng.choice(words) for _ in range(8)]
        if i % 15 == 0:
            line += ["Mailbox:", f"user{i}@example.org"]
        rows.append((i, " ".join(line)))
    # Ten copies of one text: its other words stand beside one address only.
    rows += [(1000 + i, "singular phrase by solo@example.org") for i in range(10)]
    docs = make_docs(rows)
    got = {r["doc_id"]: r["spans"] for r in privacy.privacy_query(docs).collect()}
    texts = dict(rows)
    for key, spans in got.items():
        terms = [s for s in spans.split(",") if s.startswith("term")]
        cut = [texts[key][int(a):int(b)] for _, a, b in (s.split(":") for s in terms)]
        assert cut == (["Mailbox"] if "Mailbox" in texts[key] else [])
    clean = {r["doc_id"]: r for r in privacy.without_personal_data(docs).collect()}
    assert clean[0]["text"].endswith(" : <email>") or clean[0]["text"].endswith(" <term>: <email>")
    assert clean[1]["text"] == texts[1] and clean[1]["n_chars"] == len(texts[1])
    assert clean[1000]["text"] == "singular phrase by <email>"
