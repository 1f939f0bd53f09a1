import itertools
import re

import numpy as np

from probeline.llm import audit

LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (4, "short", "a"), (4, "short", "a"), (5, "", "b"), (6, None, "b"), (None, LONG, "a"),
    (None, "", ""), (7, "word " * 70, "b"), (8, "ABC DEF " * 40, "b"), (9, LONG + " #", "a"), (10, "x" * 300_000 + " $", "c"), (0, "é" * 30, "c"),
    (11, LONG + " İ", "c"), (2, "another text", "a"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, 0, 1), (5, None, 1), (7, 0, 0), (8, 1, 1), (8, 1, 1), (None, 1, 1)]


def failed(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        out.append((i, part or "", {x for x, bad in fails.items() if bad}))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = {}
    docs = failed(rows)
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                late = sum(x in f for _, f in mine) - len(gone)
                left = [(i, f) for i, f in left if x not in f]
                share[x] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), late, sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(share[order[step - 1]])
    return found


def test_audit_against_plain_loops(spark):
    rows = [(*r, "x", "y", 3) for r in ROWS * 2]  # all rows twice, with clashing extra columns
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, name string, part string, mask int")
    labels = spark.createDataFrame([(*x, 7) for x in LABELS], "doc_id long, quality int, toxic int, n int")
    got = audit.interactions(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got}
    assert len(found) == len(got) == 4 * 600 and found == brute(ROWS * 2, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs, labels).count() == 0
    some = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert sum(r["good_lost"] + r["toxic_lost"] for r in audit.interactions(some, labels).collect()) == 0


def test_removal_steps_are_the_min_plus_product():
    order = audit.orders(4)
    masks = np.arange(16)
    found = audit.removal_steps(masks, audit.positions(order))
    for row, o in enumerate(order.tolist()):
        for m in masks.tolist():
            assert found[row, m] == min((i + 1 for i, x in enumerate(o) if m >> x & 1), default=audit.NEVER)
