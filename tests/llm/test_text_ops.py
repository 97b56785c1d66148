"""Operators that judge each text by itself, against plain Python and the libraries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tidemark.llm import bpe, licenses, quality, queries, text, token_counts

WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b c d", "a b c d e", "ÄÖ ß x y z\x1cw q", "x\x00y z", "😀 漢字 é", "A b\tC\x0bd\x0ce\rf\ng", "word " * 300, "no-space" * 4000, "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "  lead and trail  ", "1234567 12,5 3.14"]


def documents(spark, texts, extra=True):
    rows = [(i if i % 7 else None if i == 7 else i, t, "en", "s", 1, 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long")
    return df if extra else df.select("doc_id", "text")


def by_text(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def random_texts(n, seed=3, alphabet=("the", "of", "Zug", "été", "niño", "a", "ing", "x1", "2024", "—", "don't", "I'll", "  ", "\n", "..", "漢字")):
    rng = random.Random(seed)
    return [" ".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(n)]


def test_words_and_shingles():
    for piece in (1 << 20, 7, 64):
        old, text.PIECE = text.PIECE, piece
        try:
            texts = [*ODD, *random_texts(30)]
            hashes, offsets = text.words(pa.array(texts, pa.string()))
            seen = {}
            for i, t in enumerate(texts):
                own = WORD.findall(t or "")
                got = hashes[offsets[i] : offsets[i + 1]].tolist()
                assert len(own) == len(got)
                for w, h in zip(own, got, strict=True):
                    assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
        finally:
            text.PIECE = old
    sets = text.shingles(pa.array(texts, pa.string()))
    for t, s in zip(texts, sets, strict=True):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1))
    a, b = text.shingles(pa.array(["a B c", "A b C"]))
    assert a.tolist() == b.tolist()


def plain_quality(t):
    t = t or ""
    words, lines, dup, seen = WORD.findall(t), t.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_quality_base(spark):
    texts = [*ODD, *random_texts(60), "l1 a\nl1 a\n\n\nl2\nl1 a", "a a a a a", "#*$%&|<> x"]
    got = quality.quality(documents(spark, texts).coalesce(1))
    assert by_text(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == [plain_quality(t) for t in texts]


def test_quality_bands():
    rng = random.Random(1)
    natural = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(33, 0x24F)) for _ in range(12)) for _ in range(400))
    repeated = " ".join(f"{w} x{i}" for i, w in enumerate(["lorem ipsum dolor sit amet consectetur adipiscing elit sed"] * 300))
    compress = zstandard.ZstdCompressor(level=3).compress
    verdict = lambda t: quality.judge(t, compress)[-1]
    assert verdict(natural) and not verdict(noise) and not verdict(repeated)
    mixed = natural[:4096] + noise  # over a third of the chunks outside
    assert quality.judge(mixed, compress)[-2] > 1 / 3 and not verdict(mixed)


def test_quality_keeps_columns(spark):
    texts = [*ODD, *random_texts(20)]
    kept = quality.keep_good(documents(spark, texts))
    verdicts = {r.doc_id: r.kept for r in quality.quality(documents(spark, texts)).collect()}
    assert kept.columns == documents(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in verdicts.items() if v)


def test_quality_packs_large_codes():
    rng = random.Random(2)
    words = [str(rng.randint(0, 60)).encode() for _ in range(3000)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    from collections import Counter

    count = Counter(windows)
    assert quality.repeated_words(words) == len({j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)})


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 256), (200, 60), (40, 34)])
def test_token_counts(spark, model, chunk, overlap):
    texts = [*ODD, *random_texts(40), "▁▁ ▁", "a" * 3000, " " * 3000, "=" * 999]
    got = token_counts.token_counts(documents(spark, texts).coalesce(1), queries.tokenizer("piece_bpe_32k.model"), chunk=chunk, overlap=overlap, limit=100)
    want = [(len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for t in texts]
    assert by_text(got, "n_bytes", "n_tokens", "over_limit") == want


def test_overlaps_widen(model):
    counter = token_counts.PieceCounter(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read(), 64, 33)
    for t in ("=" * 500, "ab" * 400, "-" * 100 + " the end " * 30, " " * 700):
        assert counter.count(t) == len(model.encode(t))
    assert counter.widened > 0


def test_unstable_stretches_take_linear_time(model):
    import time

    counter = token_counts.PieceCounter(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())
    for t in ("a" * 1_500_000, "ab" * 500_000, " " * 1_000_000, "the end " * 5000 + "=" * 300_000 + " and on " * 5000):
        began = time.perf_counter()
        assert counter.count(t) == len(model.encode(t))
        assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


def test_bpe_round_trip(spark, library):
    texts = [*ODD, *random_texts(60), "".join(map(chr, range(0x20, 0x500))), "hahahahaha " * 50, "\x85 x\x1c 　"]
    path = queries.tokenizer("byte_bpe_50k.json")
    got = bpe.round_trip(documents(spark, texts).coalesce(1), path).collect()
    for r, t in zip(got, texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(documents(spark, texts).coalesce(1), path)
    assert [r.text for r in bpe.decode_documents(encoded, path).collect()] == [t or "" for t in texts]


def test_long_words(library, monkeypatch):
    rng = random.Random(30)
    coder = bpe.ByteBPE(open(queries.tokenizer("byte_bpe_50k.json"), "rb").read())
    texts = ["a" * 200_000, "hello" * 9000, "".join(rng.choices("etaoinshrdlu", k=30_000)), "".join(rng.choices("0123456789", k=9000)), "é漢" * 4000, "\n" * 5000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in texts] == want
    monkeypatch.setattr(bpe, "KEPT_TRANSITIONS", 50)  # the table begins anew inside of words
    coder.transitions.forget()
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in texts] == want


def test_every_transition_has_one_label():
    """All labels that arcs allow at a place, found by trying every token, are the one that the table gives."""
    rng = random.Random(31)
    coder = bpe.ByteBPE(open(queries.tokenizer("byte_bpe_50k.json"), "rb").read())
    for _ in range(60):
        word = "".join(rng.choices("theaing .", k=rng.randint(1, 30))).encode()
        last = coder.transitions.labels(word)
        for end in range(1, len(word) + 1):
            fits = [i for i in (coder.ids.get(word[at:end]) for at in range(end)) if i is not None]
            fits = [i for i in fits if end == coder.size[i] or coder.automaton.arc(last[end - coder.size[i] - 1], i)]
            assert fits == [last[end - 1]]


def explicit_automaton(letters, merges):
    """The gadget construction with all states and arcs written out."""
    arcs = {0: dict.fromkeys(letters, 0)}
    for u, v in merges:
        w = u + v
        split = {a[u] for a in arcs.values() if u in a and v in arcs[a[u]]}
        for s in split:
            to, copy = arcs[s][v], max(arcs) + 1
            arcs[copy] = {x: t for x, t in arcs[s].items() if x != v}
            for a in list(arcs.values()):
                if a.get(u) == s:
                    a[u] = copy
                    a[w] = to
    return arcs


def test_automaton_equals_the_written_out_one():
    rng = random.Random(5)
    for _ in range(60):
        letters = "abc"[: rng.randint(2, 3)]
        tokens, merges = list(letters), []
        for _ in range(rng.randint(1, 12)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        number = {t: i for i, t in enumerate(tokens)}
        automaton = bpe.MergeAutomaton([number[c] for c in letters])
        for u, v in merges:
            automaton.gadget(number[u], number[v], number[u + v])
        arcs = explicit_automaton(letters, merges)
        reached = {t: arcs[0][t] for t in tokens if t in arcs[0]}
        for t, state in reached.items():
            for x in reached:
                assert automaton.arc(number[t], number[x]) == (x in arcs[state]), (merges, t, x)


def test_automaton_rejects_improper_merges():
    automaton = bpe.MergeAutomaton([0, 1])
    with pytest.raises(ValueError):
        automaton.gadget(0, 5, 6)


NOTICE = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "LicenseRef-all-rights-reserved", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}


def test_licences(spark):
    texts = [*ODD, *(f"some text here.\n{n}\nmore of it" for n in NOTICE), *(f"Some words. {n} Other words." for n in NOTICE), "the mit license is nice", "licensed", None]
    got = licenses.scan_licenses(documents(spark, texts)).collect()
    names = list(NOTICE.values())
    base = len(ODD)
    assert sorted((r.doc_id, r.license) for r in got) == sorted((i + base, names[i % 5]) for i in range(10))


def test_licence_rules_are_ordered():
    scanner = licenses.Scanner()
    parts = [licenses.SENTENCES[k][0] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")]
    name = lambda ps: [m.license for m in scanner.scan("\n".join(ps))]
    assert name(parts) == ["BSD-3-Clause"] and name(parts[:3]) == ["BSD-2-Clause"] and name(parts[::-1]) == []
    assert name([parts[0], "x", "y", parts[1], parts[2]]) == ["BSD-2-Clause"]
    assert name([parts[0], "x", "y", "z", parts[1], parts[2]]) == []
    wrapped = re.sub(r"(.{30,50}) ", r"\1\n", parts[1])
    assert name([parts[0], "  1. " + wrapped, " * " + parts[2]]) == ["BSD-2-Clause"]
    assert [m.license for m in scanner.scan("SPDX-License-Identifier: GPL-3.0-only")] == ["GPL-3.0-only"]


def plain_licences(scanner, text):
    """All runs of segments looked up as wholes, and all rules tried in order."""
    raw = re.split(r"\n|(?<=[.!?;:])[\x20\x09\x0B-\x0D]+", text)
    own = [(i, licenses.words_of(s)) for i, s in enumerate(raw)]
    own = [(i, w) for i, w in own if w]
    found, at = [], 0
    while at < len(own):
        runs = [(last, " ".join(w for _, ws in own[at : last + 1] for w in ws)) for last in range(at, min(len(own), at + 90))]
        hits = [(last, scanner.known[run]) for last, run in runs if run in scanner.known]
        if hits:
            found.append((at, hits[-1][0], hits[-1][1]))
            at = hits[-1][0]
        at += 1
    out, used = [], set()
    rules = licenses.sequences()
    for i in range(len(found)):
        for license, names in rules if i not in used else ():
            places = []
            for name in names:
                after = [p for p in range(i if not places else places[-1] + 1, len(found)) if p not in used and found[p][2] == name]
                if not after or (places and found[after[0]][0] - found[places[-1]][1] - 1 > 2) or (not places and after[0] != i):
                    break
                places.append(after[0])
            else:
                used |= set(places)
                out.append((license, len(names), own[found[places[0]][0]][0], own[found[places[-1]][1]][0]))
                break
    return out


def wrapped_at(words, width):
    lines = [""]
    for w in words:
        if lines[-1] and len(lines[-1]) + len(w) >= width:
            lines.append("")
        lines[-1] += (" " if lines[-1] else "") + w
    return lines


def test_licences_against_brute_force():
    rng = random.Random(33)
    scanner = licenses.Scanner()
    names = list(licenses.SENTENCES)
    total = 0
    for _ in range(150):
        text = []
        for _ in range(rng.randint(1, 4)):
            _, rule = rng.choice(licenses.RULES)
            for name in rule.split():
                if name.endswith("?") and rng.random() < 0.4:
                    continue
                name = name.removesuffix("?") if rng.random() < 0.95 else rng.choice(names)
                sentence = rng.choice(licenses.SENTENCES.get(name) or [f"Released under {licenses.NAMES[name[7:]][0]}"])
                head, mark = rng.choice([("", ""), ("", "1. "), ("// ", ""), (" * ", ""), ("# ", "(a) ")])
                text += [head + x for x in wrapped_at((mark + sentence).split(), rng.choice([20, 24, 30, 36, 45, 60, 79, 500]))]
                text += [rng.choice(["", "*" * 210, "some other line", " " * 150])] * rng.choice([0, 0, 1, 1, 3])
        text = "\n".join(text)
        got = [(m.license, m.n_sentences, m.first, m.last) for m in scanner.scan(text)]
        assert got == plain_licences(scanner, text)
        total += len(got)
    assert total > 200


@pytest.mark.parametrize("width", [20, 24, 30, 36, 45, 80, 1000])
def test_whole_licences_at_any_width(width):
    scanner = licenses.Scanner()
    for license, rule in licenses.RULES:
        if not rule.startswith("notice."):
            text = "\n\n".join("\n".join(" * " + x for x in wrapped_at(licenses.SENTENCES[n.removesuffix("?")][0].split(), width)) for n in rule.split())
            assert [(m.license, m.n_sentences) for m in scanner.scan(text)] == [(license, len(rule.split()))], license


def test_licence_names_and_expressions():
    name = lambda t: [m.license for m in licenses.Scanner().scan(t)]
    assert name("Released under the MIT licence.") == ["MIT"] and name("License: EUPL 1.2") == ["EUPL-1.2"]
    assert name("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT OR Apache-2.0"]
    assert name("SPDX-License-Identifier: bsl-1.0\ncode") == ["BSL-1.0"]
    assert name("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND (MIT OR ISC) */") == ["(GPL-2.0-only WITH Linux-syscall-note) AND (MIT OR ISC)"]
    assert name("SPDX-License-Identifier: none of these") == [] and name("SPDX-License-Identifier:") == []
    assert name("*" * 210 + " All rights reserved.") == ["LicenseRef-all-rights-reserved"] and name("All" + " " * 120 + "rights reserved.") == ["LicenseRef-all-rights-reserved"]
    assert name("Apache License\n    Version 2.0, January 2004\n http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION") == ["Apache-2.0"]
    assert name("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n") == ["GPL-3.0-only"] and name("GNU GENERAL PUBLIC LICENSE") == []


def test_crc_is_unsigned():
    assert zlib.crc32("é".encode()) >= 0


def test_empty_tables(spark):
    none = documents(spark, [])
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0
    assert token_counts.token_counts(none, queries.tokenizer("piece_bpe_32k.model")).count() == 0
    path = queries.tokenizer("byte_bpe_50k.json")
    assert bpe.round_trip(none, path).count() == 0 and bpe.decode_documents(bpe.encode_documents(none, path), path).count() == 0
    assert licenses.scan_licenses(none).count() == 0


def plain_verdict(t, chunk=4096):
    """The verdict of the compression bands, written out anew."""
    raw = (t or "").encode()
    if plain_quality(t)[-1]:
        return False

    def inside(piece):
        ratio, limits = len(zstandard.ZstdCompressor(level=3).compress(piece)) / len(piece), None
        for least, low, high in quality.BANDS:
            if len(piece) >= least:
                limits = low, high
        return limits[0] <= ratio <= limits[1]

    pieces = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    outside = sum(len(p) for p in pieces if not inside(p)) if len(pieces) > 1 else 0
    return inside(raw) and 3 * outside <= len(raw)


def test_quality_verdicts(spark):
    rng = random.Random(32)
    word = lambda letters="etaoinshrdlu": "".join(rng.choices(letters, k=rng.randint(2, 9)))
    texts = [*ODD]
    for _ in range(60):
        kinds = {"prose": lambda: word(), "noise": lambda: "".join(chr(rng.randint(33, 0x24F)) for _ in range(9)), "few": lambda: rng.choice(["alpha", "beta", "gamma"]) + str(rng.randint(0, 30)), "hex": lambda: f"{rng.getrandbits(64):x}"}
        texts.append(" ".join(kinds[k]() for k in rng.choices([*kinds], k=rng.randint(1, 3)) for _ in range(rng.choice([10, 60, 300, 2000]))))
    got = by_text(quality.quality(documents(spark, texts).coalesce(1)), "kept")
    want = [(plain_verdict(t),) for t in texts]
    assert got == want and {w for (w,) in want} == {True, False}
