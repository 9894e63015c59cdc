import random
import re

from tabsynth.llm import linededup as ld


def brute(rows, cut=ld.ENDS["line"], least=4):
    """Per (doc_id, text): the cleaned text. Every unit has a key: its words or, if they are few, those of its neighbours as well."""
    docs = {}
    for d, x in rows:
        docs.setdefault((d is None, d or 0, d, x), None)
    ordered = sorted(docs, key=lambda k: (k[0], k[1]))
    seen, out = set(), {}
    for _, _, d, x in ordered:
        parts, at = [], 0
        for m in re.finditer(cut, x or ""):
            parts.append(x[at : m.end()])
            at = m.end()
        parts = [p for p in [*parts, (x or "")[at:]] if p]
        words = [tuple(p.encode().lower().split()) for p in parts]
        full = [i for i, w in enumerate(words) if w]
        kept, size = list(parts), {i: len(words[i]) for i in full}
        for place, i in enumerate(full):
            before = next((j for j in range(place, -1, -1) if sum(size[q] for q in full[j : place + 1]) >= least), 0)
            after = next((k for k in range(place, len(full)) if sum(size[q] for q in full[before : k + 1]) >= least), len(full) - 1)
            unit = (place - before, *(words[q] for q in full[before : after + 1])) if size[i] < least else words[i]
            if unit in seen:
                kept[i] = None
            seen.add(unit)
        clean = "".join(k for k in kept if k is not None)
        out[d, x] = None if x is None else clean.rstrip(" \t\n\v\f\r") if kept and kept[-1] is None else clean
    return out


def test_cleaned_texts(spark):
    a, b, c = "One two three four", "This is  a LONG line", "no no no no no"
    rows = [(5, f"{a}\nshort\n{b}"), (2, f"{b}\n{a}\nshort\nnew words are here"), (9, a), (7, None), (8, ""), (3, f"{c}\n{c}\nx"), (None, f"{c}\nlast one of all"), (9, a), (6, f"{a.upper()}\t\n")]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, digest string, t int")
    got = ld.drop_repeated_units(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert r.text == want[r.doc_id, texts[r.doc_id]], r
        assert (r.digest, r.t) == ("q", 1)
        if r.text is not None:
            assert r.text == "".join(texts[r.doc_id][s.start : s.stop] for s in r.kept_spans)
            assert r.n_removed == len(r.removed)
    assert ld.drop_repeated_units(docs.limit(0)).count() == 0


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b c d\ne f\n\nx"), (2, "a b c d\nE F\n\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.drop_repeated_units(docs, unit="paragraph").collect()}
    assert got == {1: "a b c d\ne f\n\nx", 2: "y"}


def test_passages_within_lines(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
    prose = lambda n: "".join(word() + rnd.choice([" "] * 8 + [", ", ". ", "! ", ".\n", "\n\n"]) for _ in range(n))
    passage = prose(80)
    rows = [(i, prose(rnd.randint(0, 90)) + (passage if i % 3 == 0 else "") + prose(rnd.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(9)] + [(3, rows[3][1]), (None, rows[7][1]), (200, "Yes. No."), (201, "Yes. No."), (202, "No."), (203, "\n \n"), (204, "x. " * 30), (205, "many words here " * 20_000)]
    names = ["doc_id", "text", "_removed", "_key", "_t", "row", "t", "places", "gone_id", "places"]
    docs = spark.createDataFrame([(*r, *range(7)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{n} long" for n in names[2:9])])).repartition(3)
    for unit in ld.ENDS:
        want = brute(rows, ld.ENDS[unit], 8 if unit == "clause" else 4)
        got = ld.drop_repeated_units(docs, unit=unit).collect()
        assert len(got) == len(rows)
        texts = {(r.doc_id, r.text) for r in got}
        assert texts == {(d, x) for (d, _), x in want.items()}
        assert all(tuple(r)[2:9] == tuple(range(7)) for r in got)
    inner = " ".join(passage.split()[10:-10])
    assert sum(inner in " ".join((r.text or "").split()) for r in got) == 1
