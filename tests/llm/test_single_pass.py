"""Operators on single documents and small joins, against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from kinetrail.llm import chat, leaks, lines, mixing, quality, secrets, tokens
from pyspark.sql import functions as F

from .fixtures import SCHEMA, awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_mix(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward())
    sizes: dict = {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken <= 2 * r.size
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1, 5, 2, 1], strict=False))
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not over:
            want |= {s: weights[s] * level for s in open_}
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(math.isclose(r.target, want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0


def test_mix_of_nothing_but_empty_texts(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\|x|> <\\\\/s>", None, "", "a\nb<|image|>", "%0A%25", "[\\INST]"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", None, "a\nb%25<|"])]
    rows += [(None, 0, "assistant", "null id"), (0, 2, "assistant", "tie"), (0, 2, "assistant", "tie"), (1, None, "user", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(table.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {
        r.conv_id: r
        for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
            "loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))
        ).collect()
    }
    for c in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
        want = [(r or "", t or "") for _, r, t in mine]
        assert [tuple(t) for t in got[c].turns] == want
        assert got[c].loss == "".join(t for r, t in want if r == "assistant")
        assert got[c].n_turns == len(want)
    assert chat.format_chat(table.where("false").withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts(spark):
    kinds = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    parts = [("text", "see <|image|>", None, None), ("image", None, "a.png", 7), ("audio", None, "b.wav", None), ("film", None, "c", None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", None)]
    got = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kinds}")).first()
    assert got.formatted == "<s>user\nsee <\\|image|><|image|><|audio|><|file|></s><s>assistant\n</s>"
    assert [tuple(a) for a in got.attachments] == [(1, 2, "image", "a.png", 7), (1, 3, "audio", "b.wav", 128), (1, 4, "film", "c", 0)]
    assert got.expanded_tokens == 135


def test_chat_texts_that_touch(spark):
    """Control strings cut at any place into text parts, placeholders between some of them."""
    kinds = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    rng = random.Random(4)
    marks = ["</s>", "<s>", "[INST]", "[/INST]", "<|image|>", "<\\|x|>", "\x01b", "\x01", "a", "é😀", ""]
    rows, want = [], {}
    for c in range(150):
        text = "".join(rng.choices(marks, k=rng.randint(0, 6)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 5)))
        parts, shown, files = [], "", 0
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            parts.append(("text", text[a:b], None, None))
            shown += text[a:b]
            if rng.random() < 0.2:
                kind = rng.choice(["image", None, "odd"])
                parts += [(kind, None, "r", 3), None]
                shown += "<|image|>" if kind == "image" else "<|file|>"
                files += 1
        rows.append((c, 0, "assistant", parts))
        want[c] = (shown, files)
    out = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, TURN long, role string, parts {kinds}"), turn_col="turn")
    back = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in back.collect():
        shown, files = want[r.conv_id]
        assert [tuple(t) for t in r.turns] == [("assistant", shown)], r
        assert r.loss == shown and len(r.attachments) == files and r.expanded_tokens == 3 * files


def test_many_shared_lines(spark):
    """Reassembly is linear: six documents of 80,000 shared lines each."""
    shared = [f"a line that all of these documents share, number {i:06d}" for i in range(80_000)]
    rows = [(i, "\n".join([f"own {i}", *shared, ""]), "x", "y") for i in range(6)]
    began = time.monotonic()
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, N_LINES string, n_dropped string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert time.monotonic() - began < 60
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert got == {i: (f"own {i}\n", 80_002, 80_000) for i in range(5)} | {5: (rows[5][1], 80_002, 0)}


def test_clashing_names(spark):
    """Columns named as an operator's own, in other case, give way to them."""
    names = "doc_id long, text string, source string, N_Words string, N_TOKENS string, Items string, KEPT string, Taken string, secrets string"
    table = spark.createDataFrame([(1, "one two three", "a", *"uvwxyz")], names)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert leaks.scan_leaks(table, bench).select("n_words", "items").first() == (3, ["1"])
    assert quality.quality(table).select("n_words", "kept").first() == (3, False)
    assert tokens.with_token_counts(table).select("n_tokens").first()[0] > 0
    assert mixing.mix(table).select("taken").first() == (3,)


@pytest.mark.parametrize("bound", [8 << 20, -1])
def test_lines(docs, empty, monkeypatch, bound):
    monkeypatch.setattr(lines, "BROADCAST", bound)
    rows = awkward()
    keys = lambda t: [low(x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")]
    holders: dict = {}
    for r in rows:
        for k in keys(r[1]):
            if len(k) >= 40:
                holders.setdefault(k, set()).add(r[0])
    want = Counter()
    for r in rows:
        drop = [
            len(holders.get(k, ())) >= 5 and r[0] != max(holders[k], key=lambda d: (d is not None, d or 0)) for k in keys(r[1])
        ]
        text = "\n".join(x for x, d in zip((r[1] or "").split("\n"), drop, strict=True) if not d)
        want[r[0], text, len(drop), sum(drop)] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect())
    assert got == want
    assert lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("chunk", [(32_768, 16_384, 512), (200, 100, 16), (60, 40, 4)])
def test_tokens(docs, empty, chunk):
    got = tokens.with_token_counts(docs, huge=chunk[0], chunk=chunk[1], overlap=chunk[2]).collect()
    own = tokens._tokenizer(tokens.VOCABULARY)
    assert len(got) == len(awkward())
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(own.encode(t, add_special_tokens=False)))
    assert tokens.with_token_counts(empty).count() == 0


def _leak_docs(rows):
    item = "One two three four five six seven eight nine ten eleven twelve"
    short = "rare short item"
    return rows + [
        (200, f"x {item}! y", "en", "a", 1, None, None, None),
        (201, f"a, Rare-SHORT; item b {item[4:]} and {item[:-7]}", "en", "a", 1, None, None, None),
    ], [(1, item), (10, short), (2, item), (3, None), (4, "..."), (None, "four five six seven eight nine ten eleven twelve x7"), (1, item)]


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_leaks(spark, bound):
    rows, items = _leak_docs(awkward())
    table = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: word.findall(low(t or ""))
    grams = {("null" if i is None else str(i), tuple(of(t)[k : k + 10])) for i, t in items for k in range(max(1, len(of(t)) - 9)) if of(t)}
    got = leaks.scan_leaks(table, bench, bound=bound).collect()
    assert len(got) == len(rows)
    for r in got:
        words, hit, found = of(r.text), set(), set()
        for i, g in grams:
            for k in range(len(words) - len(g) + 1):
                if tuple(words[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(i)
        assert (int(r.n_words), r.n_hit, r["items"]) == (len(words), len(hit), sorted(found)), r.doc_id
    assert {200, 201} <= {r.doc_id for r in got if r.n_hit}
    assert leaks.scan_leaks(table.where("false"), bench).count() == 0
    assert leaks.scan_leaks(table, bench.where("false")).where("n_hit > 0").count() == 0
    cut = {r.doc_id: r.text for r in leaks.decontaminate(table, bench, mode="span", bound=bound).collect()}
    assert cut[200] == "x ! y" and cut[201] == "a,  b  and "
    assert not {200, 201} & {r.doc_id for r in leaks.decontaminate(table, bench, bound=bound).collect()}


def test_leaks_of_a_common_window(spark):
    """A window that far more items share than a broadcast holds."""
    bench = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit("Alpha beta gamma").alias("text"))
    bench = bench.unionByName(spark.createDataFrame([(-1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string"))
    table = spark.createDataFrame(
        [(1, "x alpha BETA, gamma y"), (2, "beta gamma"), (3, None), (4, "zero one two three four five six seven eight nine ten eleven"), (1, "x alpha BETA, gamma y")],
        "doc_id long, text string",
    )
    got = leaks.scan_leaks(table, bench, bound=1_000).select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.col("hit_runs.start").alias("a")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 5, 3, 100_000, [1])] * 2 + [(2, 2, 0, 0, []), (3, 0, 0, 0, []), (4, 12, 11, 1, [1])]


#: The base kinds as the contract words them, over code points.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.A, 0, 20),
    ("hex", r"[0-9a-f]+", re.A, 0, 24),
)


def test_secrets(docs, empty):
    got = secrets.find_secrets(docs).collect()
    assert len(got) == len(awkward())
    plain = [(secrets.Rule(kind, b"", group=group, least=least), re.compile(p, flags)) for kind, p, flags, group, least in BASE]
    plain += [(r, re.compile(r.pattern.decode(), re.I | re.A if r.any_case else re.A)) for r in secrets.RULES[3:]]
    some = 0
    for r in got:
        want = sorted(
            (m.start(), k, rule.kind, m.end())
            for k, (rule, pattern) in enumerate(plain)
            for m in pattern.finditer(r.text or "")
            if m.end(rule.group) - m.start(rule.group) >= rule.least
        )
        assert [(s.start, s.kind, s.end) for s in r.secrets] == [(a, kind, b) for a, _, kind, b in want]
        some += len(want)
    assert some > 20
    assert secrets.find_secrets(empty).count() == 0
    one = secrets.find_secrets(docs.where("doc_id = 0")).select(secrets.redact(F.col("text"), F.col("secrets")).alias("t")).first().t
    assert "abcDEF123456" not in one and "AKIA" not in one and "0123456789abcdef" not in one


def test_trigram_queries():
    assert secrets.trigram_query(rb"[0-9a-f]+") is None
    assert secrets.trigram_query(rb"ab|cde") is None
    assert secrets.trigram_query(rb"(abc|xyz)?") is None
    assert secrets.trigram_query(rb"AKIA[A-Z]+") == ("and", b"aki", b"kia")
    assert secrets.trigram_query(rb"x+abc") == b"abc"


def test_quality_features(docs, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(awkward())
    for r in got:
        t = r.text or ""
        words = WORD.findall(t)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), dup, len(hit))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_votes_recover_accuracies():
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9])
    votes = np.where(rng.random((20_000, 5)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    posterior, accuracy, share = quality.fit_votes(patterns, times.astype(float), strength=0.0)
    assert abs(share - 0.8) < 0.03 and np.abs(accuracy - right).max() < 0.06
    score = {tuple(p): x for p, x in zip(patterns, posterior, strict=True)}
    assert np.mean([(score[tuple(v)] > 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.95


def test_quality_agrees_with_labels(spark):
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = quality.quality(spark.read.parquet(f"{path}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) < 0.5


@pytest.mark.parametrize("kind", ["letters", "base64", "repeats", "special"])
def test_tokens_without_blanks(kind):
    """Texts without blanks splice inside runs of letters, and give what the whole text gives."""
    draw = random.Random(11)
    ideographs = [chr(c) for c in range(0x4E00, 0x5100)]
    pool = {
        "letters": ideographs,
        "base64": list("abcdefghijXYZ0123456789+/="),
        "repeats": ["ab"],
        "special": ["<|endoftext|>", "abc", "'s", "<|", "|>", "7", "don't"],
    }[kind]
    own, spliced = tokens._tokenizer(tokens.VOCABULARY), 0
    for limit, overlap in [(300, 200), (1000, 128), (777, 333)]:
        text = "".join(draw.choice(pool) for _ in range(3000))
        n = -(-(len(text) - overlap) // limit)
        cut = [text[k * limit : (k + 1) * limit + overlap] if k < n - 1 else text[k * limit :] for k in range(n)]
        parts = [tokens.chunk_tokens(w, k == 0, k == n - 1, overlap) for k, w in enumerate(cut)]
        if all(b[1] >= 0 and b[1:3] == a[3:5] for a, b in zip(parts, parts[1:], strict=False)):
            spliced += 1
            assert sum(p[0] for p in parts) == len(own.encode(text, add_special_tokens=False))
    assert spliced or kind == "special"


def test_pieces_count_as_whole_texts():
    """Pieces add up to what the library gives for the whole text, whatever stands side by side."""
    draw, own = random.Random(4), tokens._tokenizer(tokens.VOCABULARY)
    pool = [*" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u3000\u200b\u0301'\u2019aZ09_.,-#\u00aa\u00b5\u00d7\u00e9\u0250\u4e00\u0661\u00b2\U0001f600"]
    pool += ["  ", "\n\n", " '", "'s", "'re", "don't", "<|", "|>", "endoftext", "<|endoftext|>", " word", "\u00e9t\u00e9", "\r\n", "\x00", "x" * 70]
    texts = ["", *("".join(draw.choices(pool, k=draw.choice([1, 2, 3, 5, 9, 60]))) for _ in range(20_000))]
    assert all("".join(tokens.PIECE.findall(t)) == t for t in texts)
    assert tokens.count_tokens(texts) == [len(own.encode(t, add_special_tokens=False)) for t in texts]


def test_known_pieces_are_not_encoded_again(monkeypatch):
    own, seen = tokens._tokenizer(tokens.VOCABULARY), []

    class Recorder:
        def __getattr__(self, name):
            return getattr(own, name)

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return own.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokens, "_tokenizer", lambda _: Recorder())
    draw = random.Random(6)
    texts = [" ".join(draw.choices([f"word{chr(97 + k)}" for k in range(26)], k=500)) + "." for _ in range(300)]
    want = [len(own.encode(t, add_special_tokens=False)) for t in texts]
    assert tokens.count_tokens(texts) == want and tokens.count_tokens(texts[::-1]) == want[::-1]
    assert sum(map(len, seen)) < 2000
    monkeypatch.setattr(tokens, "KNOWN", 5)
    assert tokens.count_tokens(texts) == want and len(tokens._known(tokens.VOCABULARY)) == 0
