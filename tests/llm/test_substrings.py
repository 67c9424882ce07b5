import re

import pytest

from kinloom.llm.substring_dedup import dedup_units
from tests.llm.common import ODD, docs, words

CUT = {"line": r"\n", "paragraph": r"\n(?:[ \t\r\x0b\x0c]*\n)+", "piece": r"\n|[.!?,;:][ \t\r\x0b\x0c]+"}


def slow(ids, texts, unit, least):
    """Of each id: units, removed units, spans and what is left."""
    cut, found = {}, {}
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    for d, t in sorted(zip(ids, texts), key=lambda x: x[0]):
        t, at, cut[d], clause = t or "", 0, [], 0
        for end in [*(m.end() for m in re.finditer(CUT[unit], t)), len(t)]:
            few, clause = len(re.findall("[^ \t\n\x0b\x0c\r]+", t[clause:end])) < 4, end
            if unit == "piece" and few and t[end - 1 : end] != "\n" and end < len(t):
                continue
            if ws := [x for x in re.split("[ \t\n\x0b\x0c\r]+", lower(t[at:end])) if x]:
                found.setdefault(" ".join(ws), (d, len(cut[d])))
                cut[d].append((at, end, ws))
            at = end
    out = {}
    for d, t in zip(ids, texts):
        own, runs, run = cut[d], [], []
        for i, (_, _, ws) in [*enumerate(own), (len(own), (0, 0, None))]:
            if ws is not None and found[" ".join(ws)] != (d, i):
                run.append(i)
                continue
            if sum(len(own[k][2]) for k in run) >= least:
                runs.append(run)
            run = []
        spans, left, at = [(own[r[0]][0], own[r[-1]][1]) for r in runs], "", 0
        for x, y in spans:
            left, at = left + (t or "")[at:x], y
        out[d] = (len(own), sum(map(len, runs)), spans, left + (t or "")[at:])
    return out


SHARED = [" ".join(words(n, n)) for n in (3, 8, 12, 60)]
TEXTS = [*ODD, *("\n".join([SHARED[k % 4], " ".join(words(9, 100 + k)), SHARED[(k + 1) % 4].upper() + "  ", "", " \t", SHARED[3]]) for k in range(12)), "wörd é " * 6 + "\n" + "wörd é " * 6 + "\nend"]


PASSAGE = "One, two three; four five six? " + ", ".join(SHARED) + ". Ends here: wörd。çé，ß"
TEXTS += [" ".join(words(7, 300 + k)) + " " + PASSAGE[5 * k :] + " and\n\n" + " ".join(words(5, 400 + k)) + ", " + PASSAGE[: 250 + k] for k in range(6)]


@pytest.mark.parametrize(("unit", "least"), [("line", 8), ("line", 1), ("paragraph", 3), ("piece", 30), ("piece", 1)])
def test_against_brute_force(spark, monkeypatch, unit, least):
    monkeypatch.setattr("kinloom.llm.substring_dedup.HELD_UNITS", 20)
    ids = list(range(len(TEXTS)))[::-1]
    found = {r.doc_id: r for r in dedup_units(spark, docs(spark, TEXTS, extra=True, ids=ids).repartition(3), unit, least, keep=("lang", "place")).collect()}
    expected, texts = slow(ids, TEXTS, unit, least), dict(zip(ids, TEXTS))
    assert any(e[1] for e in expected.values())
    for d, (n, gone, spans, text) in expected.items():
        r = found[d]
        assert (r.n_units, r.n_removed, [(s.start, s.end) for s in r.spans], r.text) == (n, gone, spans, text)
        assert sum(b - a for a, b in spans) + len(text) == len(texts[d] or "")
        assert r.lang == "en" and r.place == "x"


def test_equal_rows_keep_alike(spark):
    line = " ".join(words(40, 5))
    rows = dedup_units(spark, docs(spark, [line, line, line, "x\n" + line], ids=[1, 1, 2, None])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 1), ("1", 1), ("2", 1), ("None", 0)]
    assert dedup_units(spark, docs(spark, [])).count() == 0


def test_short_repeated_lines_stay_and_passages_go(spark):
    texts = ["Home, about us, contact.\n" + " ".join(words(30, 50 + k)) + " " + PASSAGE for k in range(5)]
    rows = sorted(dedup_units(spark, docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert all(r.text.startswith("Home, about us, contact.\n") for r in rows) and rows[0].n_removed == 0
    assert all(len(r.spans) == 1 and r.spans[0].end == len(t) for r, t in zip(rows[1:], texts[1:]))
