from __future__ import annotations

import hashlib
import random
import re

import pytest

from bidloom.llm import middle

PLAN = middle.Plan()


def plain(doc_id, text, plan=PLAN):
    """The contract with string slices."""
    text = text or ""
    h = hashlib.sha256(f"{plan.key}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h4 % 100 < plan.suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    fixed = [None, "", "a", "<P>", "x<M>y", "< P>", "<<>>SPM<", ">>>", "日本語 text é😀\r\n\x0b zz", "\u0000\u0001", "word " * 3000, "ſK" * 9, "a1b2" * 40]
    return fixed + ["".join(rng.choice(["ab", "<", "P>", "S>", "é", " ", "\n", "Z", "😀"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_against_slices(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "some text here", "x", 1), (7, texts()[7], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, form int")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode(), r.restored.decode()) for r in middle.restored(middle.fill_in_middle(df)).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert middle.restored(middle.fill_in_middle(df.limit(0))).count() == 0


def test_rates(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'some words stand here' as text")
    assert {r.form for r in middle.fill_in_middle(df, middle.Plan(rate=0)).collect()} == {"plain"}
    assert {r.form for r in middle.fill_in_middle(df, middle.Plan(rate=100, suffix_first=100)).collect()} == {"spm"}
    other = middle.Plan(key="2", prefix=b"{pre}", suffix=b"{suf}", middle=b"{mid}")
    rows = middle.restored(middle.fill_in_middle(df, other), other).collect()
    assert all(r.restored == b"some words stand here" for r in rows) and any(r.output.startswith(b"{pre}") for r in rows)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_rotations(monkeypatch, block):
    monkeypatch.setattr(middle, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(200):
        x = bytes(rng.randrange(256) for _ in range(rng.randint(0, 50)))
        lo, mid, hi = sorted(rng.randint(0, len(x)) for _ in range(3))
        buffer = bytearray(x)
        middle.exchange(buffer, lo, mid, hi)
        assert bytes(buffer) == x[:lo] + x[mid:hi] + x[lo:mid] + x[hi:]


def test_cuts_at_all_places():
    for text in (b"", b"ab <S", b"<P<M", "é>😀".encode()):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                for spm in (False, True):
                    out = bytes(middle.transform(text, a, b, spm, PLAN))
                    p, m, s = text[:a], text[a:b], text[b:]
                    assert out == (b"<S>" + s + b"<P>" + p + b"<M>" + m if spm else b"<P>" + p + b"<S>" + s + b"<M>" + m)
                    assert middle.invert(out, "spm" if spm else "psm", PLAN) == text


def test_a_very_long_text(spark):
    text = "word, " * 400_000 + "日本" * 50_000
    df = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    for r in middle.restored(middle.fill_in_middle(df)).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) == plain(r.doc_id, text) and r.restored.decode() == text


def test_invalid_bytes_pass(spark):
    df = spark.sql("select 3L as doc_id, cast(unhex('61FF62C3') as string) as text")
    assert middle.restored(middle.fill_in_middle(df)).first().restored == bytes.fromhex("61FF62C3")


@pytest.mark.parametrize("marks", [(b"<P>", b"<P>", b"<M>"), (b"<P>", b"[S]", b"<M>"), (b"<<P", b"<<S", b"<<M"), (b"<P>", b"<SS>", b"<M>"), (b"P", b"S", b"M")])
def test_sentinels_that_could_meet_texts_are_refused(marks):
    with pytest.raises(ValueError, match="sentinels"):
        middle.Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])
