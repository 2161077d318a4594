"""License scans against every window of the same grid, compared exactly."""

import random
import re

import numpy as np
from kinetrail.llm import licenses

from .fixtures import SCHEMA, awkward


def test_against_all_windows(spark):
    rng = random.Random(4)
    fill = [f"w{i}" for i in range(300)]
    rows = awkward(n=20)
    for i in range(120):
        words = rng.choices(fill, k=rng.randint(0, 200))
        for _ in range(rng.randint(1, 3)):
            words += rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                words[-rng.randint(1, 5)] = "changed"
            words += rng.choices(fill, k=rng.randint(0, 60))
        rows.append((1000 + i, " ".join(words), None, None, None, None, None, None))
    got = licenses.find_licenses(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    library = licenses.Library(licenses.TEMPLATES)
    found = 0
    for r in got:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        k = min(5, len(words))
        grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
        want = set()
        for t, (template, (_, text)) in enumerate(zip(library.templates, licenses.TEMPLATES, strict=True)):
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            own = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
            for i in range(0, len(grams), template.scale):
                if 100 * len(own & set(grams[i : i + 2 * template.scale])) >= 75 * len(own):
                    want.add((t, i // template.scale))
        merged = sum((t, i - 1) not in want for t, i in want)
        assert len(r.licenses) == merged, r.doc_id
        assert {m.template for m in r.licenses} == {t for t, _ in want}
        found += merged
    assert found > 120
    assert licenses.find_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_span_and_name():
    library = licenses.Library(licenses.TEMPLATES)
    assert library.matches(b"one two Released under the MIT License. three") == [
        {"license": "MIT", "template": 0, "start": 2, "end": 7, "share": 1.0}
    ]
    assert library.matches(b"") == [] and library.matches(b"released under the mit") == []


def test_collisions_are_as_likely_as_stated():
    library = licenses.Library(licenses.TEMPLATES)
    rng = random.Random(9)
    lost = 0
    for _ in range(400):
        words = [f"x{rng.randrange(10**6)}" for _ in range(60)]
        at = rng.randrange(50)
        text = " ".join(words[:at] + ["Released under the MIT License"] + words[at:]).encode()
        lost += not any(m["template"] == 0 for m in library.matches(text))
    assert lost <= 1
    assert all(np.all(np.diff(t.hashes.astype(float)) > 0) for t in library.templates)


def test_recall_of_every_template():
    """Each template with up to 4 % of its words changed, at any place in a long text: found at least nine times of ten, where a window holds it."""
    library = licenses.Library(licenses.TEMPLATES)
    rng = random.Random(12)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        found = 0
        for _ in range(30):
            words = text.split()
            for _ in range(len(words) // 25):
                words[rng.randrange(len(words))] = "changed"
            before, after = ([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3000))] for _ in range(2))
            found += any(m["template"] == k for m in library.matches(" ".join([*before, *words, *after]).encode()))
        assert found >= 27, (k, found)


def test_stretches_leave_nothing_out(monkeypatch):
    """Matches are those of a scan of the whole text, wherever templates stand."""
    library, rng = licenses.Library(licenses.TEMPLATES), random.Random(5)
    whole = licenses.Library(licenses.TEMPLATES)
    monkeypatch.setattr(whole, "stretches", lambda hashes: [(0, len(hashes))])
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 500, 5000]))] + rng.choice(licenses.TEMPLATES)[1].split()
        text = " ".join(words).encode()
        assert library.matches(text) == whole.matches(text)
    assert library.matches(b"x " * 5000) == []


def test_full_texts_of_a_folder(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"LIC-{k}": " ".join(rng.choices([f"w{i}" for i in range(900)], k=2000 * k)) for k in (1, 3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    templates = licenses.templates_in(spark, str(tmp_path))
    assert dict(templates) == texts
    docs = [(1, "before it " + texts["LIC-3"] + " after"), (2, texts["LIC-1"][:4000]), (3, texts["LIC-1"])]
    got = licenses.find_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()
    assert {r.doc_id: {m.license for m in r.licenses} for r in got} == {1: {"LIC-3"}, 2: set(), 3: {"LIC-1"}}
