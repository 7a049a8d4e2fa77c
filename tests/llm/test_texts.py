"""Operators on single texts against brute-force versions, libraries and exact round trips."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from epochlens.llm import decontaminate, language_id, lm_scoring, media_avi, ngrams, pii, quality, sentencepiece_codec, simhash_dedup

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "Ｆｕｌｌ ｗｉｄｔｈ ﬁ ligature", "á é ½ ™", "日本語 text \U0001f600 emoji", "line\nline\ttab\r\n", "▁ mark", "x" * 5000, "​ zero ﻿ width", "\x00\x01 control", "ab " * 4000]


# --- op3


def test_ids_equal_the_library():
    c = sentencepiece_codec.codec(MODEL)
    texts = ODD + ["".join(random.Random(k).choice("ab é́ﬁ日\n ") for _ in range(60)) for k in range(40)]
    for t, (ids, spans) in zip(texts, c.encode_all([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == c.model.encode(t, add_bos=True, add_eos=True)
        assert c.decode(ids) == c.model.decode(ids.tolist())
        assert spans[-1, 1] == len(t.encode()) and (spans[:, 1] >= spans[:, 0]).all()
        assert (spans[2:, 0] == spans[1:-1, 1]).all()


def test_spaces_at_the_end_stay_apart():
    texts = [w + " " * n for n in range(6) for w in ("", "a", "the word", "b\n")]
    for k in range(40):  # in many orders, each with an empty memo
        random.Random(k).shuffle(texts)
        c = sentencepiece_codec.Codec(MODEL)
        ids, bounds = c.flat_ids([t.encode() for t in texts])
        for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == c.model.encode(t), repr(t)


def compiled_map(pairs):
    """A compiled character map with these replacements, laid out as a double array."""
    tree = {}
    for k, v in pairs.items():
        node = tree
        for b in k.encode():
            node = node.setdefault(b, {})
        node[None] = v
    blob, units, used, bases = b"", {0: 0}, {0}, set()

    def place(node, at, label):
        nonlocal blob
        base = next(b for b in range(1, 1 << 20) if b not in bases and all(b ^ (x or 0) not in used for x in node))
        bases.add(base)
        used.update(base ^ (x or 0) for x in node)
        units[at] = label | (None in node) << 8 | (at ^ base) << 10
        for x, child in node.items():
            if x is None:
                units[base] = 1 << 31 | len(blob)
                blob += child.encode() + b"\0"
            else:
                place(child, base ^ x, x)

    place(tree, 0, 0)
    flat = np.zeros(max(units) + 257, "<u4")
    for k, v in units.items():
        flat[k] = v
    return struct.pack("<I", flat.nbytes) + flat.tobytes() + blob


@pytest.mark.parametrize("seed", range(6))
def test_offsets_through_replacements(seed):
    """Longest prefixes win; replacements that grow, shrink and delete; each piece's span covers the prefix that it comes from."""
    known = {"ﬁ": "fi", "ﬁx": "FIX", "Ａ": "A", "e\u0301": "é", "\u200b": "", "½": "1/2", "ab": "b", "abc": "xyz", "\u3000": " "}
    r = random.Random(seed)
    text = "".join(r.choice([*known, "a", "b", "c", "é", "日", " ", "x", "\n"]) for _ in range(60))
    c = sentencepiece_codec.Codec(MODEL)
    c.map = sentencepiece_codec.CharMap(compiled_map(known))
    plain, origin, at = "", [], 0
    while at < len(text):
        size = next((n for n in (3, 2, 1) if text[at : at + n] in known), 0)
        new = known[text[at : at + size]] if size else text[at]
        start = len(text[:at].encode())
        plain += new
        origin += [start] * len(new.encode()) if size else list(range(start, start + len(new.encode())))
        at += size or 1
    got, places = c.map.apply(text.encode())
    assert got.decode() == plain and places.tolist() == [*origin, len(text.encode())]
    ids, spans = c.encode(text.encode())
    assert ids.tolist() == c.model.encode(plain, add_bos=True, add_eos=True)
    starts, at = [*origin, len(text.encode())], 0
    for n, ((a, b), i) in enumerate(zip(spans[1:-1].tolist(), ids[1:-1].tolist(), strict=True)):
        width = int(c.width[i]) - (n == 0)  # the space in front comes from nothing
        assert (a, b) == (starts[max(0, at)], starts[at + width])
        at += width


# --- op4


def model_and_classes(scale=0.1):
    rng = np.random.default_rng(3)
    classes = lm_scoring.Classes(rng.integers(0, 50, 500))
    flat = lm_scoring.initial(classes, rng.integers(0, 40, (classes.n + 1, classes.n))) + (rng.standard_normal(lm_scoring.SIZE) * scale).astype(np.float32)
    return flat, classes


def plain_log_chances(flat, window, targets):
    """Natural log of each target's probability, in double precision and one place at a time."""
    p = {k: v.astype(np.float64) for k, v in lm_scoring.parts(flat).items()}
    x, out = p["embed"][window] + p["place"][: len(window)], []
    for t, target in enumerate(targets):
        a = (x[: t + 1] @ p["key"]) @ (x[t] @ p["query"]) / np.sqrt(lm_scoring.WIDTH)
        a = np.exp(a - a.max())
        logits = np.concatenate([x[t], (a / a.sum()) @ (x[: t + 1] @ p["value"]), [1.0]]) @ p["out"]
        out.append(logits[target] - logits.max() - np.log(np.exp(logits - logits.max()).sum()))
    return np.array(out)


@pytest.mark.parametrize("scale", [0.1, 3.0, 12.0])
def test_scores_equal_the_plain_model(scale):
    """With wide weights as well, whose exponentials pass single precision unless they are shifted."""
    flat, classes = model_and_classes(scale)
    p, rng = lm_scoring.parts(flat), np.random.default_rng(5)
    ids = [rng.integers(0, 500, n) for n in (0, 1, 31, 32, 33, 60, 61, 200)]
    found = lm_scoring.scores(p, np.concatenate(ids), np.cumsum([0, *map(len, ids)]), classes)
    for x, got in zip(ids, found, strict=True):
        c = classes.of[x]
        seen, total, at = np.concatenate([[classes.n], c[:-1]]) if len(x) else c, 0.0, 0
        scored = np.zeros(len(x), int)
        while len(x) and (at == 0 or at + lm_scoring.WINDOW - lm_scoring.STRIDE < len(x)):
            first = 0 if at == 0 else lm_scoring.WINDOW - lm_scoring.STRIDE
            total += plain_log_chances(flat, seen[at : at + lm_scoring.WINDOW], c[at : at + lm_scoring.WINDOW])[first:].sum()
            scored[at + first : at + lm_scoring.WINDOW] += 1
            at += lm_scoring.STRIDE
        assert (scored == 1).all()
        assert got == pytest.approx(total / np.log(10) + classes.within[x].sum(), rel=1e-3, abs=1e-3)


def test_gradient_follows_the_loss():
    flat, classes = model_and_classes()
    rng = np.random.default_rng(6)
    inputs, targets, real = rng.integers(0, classes.n, (4, 32)), rng.integers(0, classes.n, (4, 32)), (rng.random((4, 32)) < 0.8).astype(np.float32)
    _, g = lm_scoring.gradient(lm_scoring.parts(flat), inputs, targets, real)
    loss = lambda f: -sum((plain_log_chances(f, x, y) * r).sum() for x, y, r in zip(inputs, targets, real, strict=True))
    at = 0
    for name, shape in lm_scoring.SHAPES.items():  # each kind of parameter by itself
        way = np.zeros(lm_scoring.SIZE)
        way[at : at + shape[0] * shape[1]] = g[at : at + shape[0] * shape[1]]
        way, at = way / np.linalg.norm(way), at + shape[0] * shape[1]
        assert (loss(flat + 1e-4 * way) - loss(flat - 1e-4 * way)) / 2e-4 == pytest.approx(float(g @ way), rel=0.01), name


def test_every_id_sees_half_a_window():
    """From the first window on, each id's chance hangs on the id half a window before it, wherever windows are cut."""
    flat, classes = model_and_classes()
    p, rng = lm_scoring.parts(flat), np.random.default_rng(8)
    ids = rng.integers(0, 500, 3 * lm_scoring.WINDOW)

    def last(x: np.ndarray) -> float:
        long, short = lm_scoring.scores(p, np.concatenate([x, x[:-1]]), np.array([0, len(x), 2 * len(x) - 1]), classes)
        return long - short

    for n in range(lm_scoring.WINDOW + 1, len(ids) + 1):
        other = ids[:n].copy()
        at = n - 1 - lm_scoring.WINDOW // 2
        other[at] = np.flatnonzero(classes.of != classes.of[ids[at]])[n % 50]
        assert abs(last(ids[:n]) - last(other)) > 1e-5, n


def test_space_of_batches_is_used_again():
    """Batches of other sizes between two equal ones change nothing, and what was given stays as it was."""
    flat, classes = model_and_classes()
    p, rng = lm_scoring.parts(flat), np.random.default_rng(9)
    batches = [(rng.integers(0, classes.n, (b, lm_scoring.WINDOW)), rng.integers(0, classes.n, (b, lm_scoring.WINDOW)), np.ones((b, lm_scoring.WINDOW), np.float32)) for b in (5, 128, 3)]
    loss, first = lm_scoring.gradient(p, *batches[0])
    held, kept = dict(lm_scoring._rooms), first.copy()
    for x in batches[1:]:
        lm_scoring.gradient(p, *x)
    assert (first == kept).all()
    again = lm_scoring.gradient(p, *batches[0])
    assert again[0] == loss and (again[1] == kept).all()
    assert held and lm_scoring.room("logits", 2, 3).base is lm_scoring._rooms["logits"]


def test_start_is_the_frequency_of_pairs():
    """With pairs of low rank the model starts as their frequencies."""
    rng = np.random.default_rng(8)
    classes = lm_scoring.Classes(rng.integers(1, 50, 500))
    kinds = rng.dirichlet(np.ones(classes.n), 3)
    pairs = (kinds[np.arange(classes.n + 1) % 3] * 1e6).astype(int)
    classes.share = pairs.sum(axis=0) / pairs.sum()
    flat = lm_scoring.initial(classes, pairs)
    lm_scoring.parts(flat)["out"][lm_scoring.WIDTH : 2 * lm_scoring.WIDTH] = 0
    window = rng.integers(0, classes.n, 32)
    got = plain_log_chances(flat, window, window)
    assert np.allclose(got, np.log((pairs[window, window] + 50 * classes.share[window]) / (pairs[window].sum(axis=1) + 50)), atol=0.02)


# --- op5


def edit_distance_of_best_stretch(item, words):
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_exact(seed):
    rng = np.random.default_rng(seed)
    item, words = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 40).astype(np.uint64)
    d, a, b = decontaminate.aligned(item, words)
    assert d == edit_distance_of_best_stretch(item.tolist(), words.tolist())
    assert edit_distance_of_best_stretch(item.tolist(), words[a:b].tolist()) == d


@pytest.mark.parametrize(("least", "most"), [(8, 20), (20, 60), (60, 120), (120, 200)])
def test_recall_of_edited_items(least, most):
    """At 0, 15 and 20 % of edits, of all three kinds, in items of mixed lengths; found exactly where a plain alignment finds them."""
    r = random.Random(least)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(r.randint(least, most))] for _ in range(40)]
    index = decontaminate.Index(list(range(40)), [" ".join(x) for x in items])
    hits = {0.0: 0, 0.15: 0, decontaminate.ERROR_RATE: 0}
    for k, item in enumerate(items):
        for rate in hits:
            changed = list(item)
            for _ in range(int(rate * len(item))):
                at = r.randrange(len(changed))
                changed[at : at + 1] = r.choice([[], [word()], [changed[at], word()]])
            text = " ".join([*(word() for _ in range(r.randint(0, 40))), *changed, *(word() for _ in range(20))])
            found = {m["item"] for m in index.matches([text])[0]}
            assert found <= {k}
            hits[rate] += k in found
    assert hits[0.0] == 40 and hits[0.15] >= 37 and hits[decontaminate.ERROR_RATE] >= 36


def test_edits_at_one_end():
    """A copy that is edited at its head and clean at its tail, of an item longer than the others of its class."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (50, 69)]
    index = decontaminate.Index([0, 1], [" ".join(x) for x in items])
    for item, k in ((items[0], 0), (items[1], 1)):
        for place in (0, len(item) - int(0.2 * len(item))):
            changed = [word() if place <= n < place + int(0.2 * len(item)) else w for n, w in enumerate(item)]
            assert [m["item"] for m in index.matches([" ".join([word(), *changed, word()])])[0]] == [k]


def test_matches_equal_every_item_against_every_text():
    """Repeated items, several items in one text and two copies of one item: the better place counts."""
    r = random.Random(17)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("0123456789")
    items = [[word() for _ in range(r.randint(10, 30))] for _ in range(12)]
    items.append(items[0])
    texts = []
    for _ in range(60):
        parts = []
        for item in r.sample(items, r.randint(0, 3)):
            for edits in r.sample([0, 1, 2], r.randint(1, 2)):
                changed = list(item)
                for _ in range(edits):
                    changed[r.randrange(len(changed))] = word()
                parts += changed + [word() for _ in range(r.randint(0, 6))]
        texts.append([word() for _ in range(r.randint(0, 10))] + parts)
    found = decontaminate.Index(list(range(len(items))), [" ".join(x) for x in items]).matches([" ".join(x) for x in texts])
    for words, got in zip(texts, found, strict=True):
        wanted = {k: d for k, item in enumerate(items) if (d := edit_distance_of_best_stretch(item, words)) <= int(decontaminate.ERROR_RATE * len(item))}
        assert {m["item"]: m["distance"] for m in got} == wanted


def test_odd_texts_match_nothing():
    index = decontaminate.Index([1], ["one two three four five six seven eight"])
    assert [[m["item"] for m in x] for x in index.matches([None, "", "  ", "...", "other words", "One two three, four five six seven eight!"])] == [[], [], [], [], [], [1]]


# --- op7

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    fits = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 10 <= len(digits(s)) <= 15}
    found = [(m.start(), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits[k](m[0])]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


@pytest.mark.parametrize("seed", range(200))
def test_rules_equal_plain_patterns(seed):
    r = random.Random(seed)
    pieces = ["a@b.c", "x.y@z", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "+49.30.1234567", " ", "-", "é", "0", "7", "+", "ab", "\n", "٣"]
    text = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
    assert pii.base_spans(text) == plain_spans(text)


def test_posteriors_by_enumeration():
    segments = [(0, 2, "card", [], 0.3), (1, 3, "phone", [], -0.2), (2, 4, "email", [], 1.1), (0, 4, "ip", [], 0.5), (3, 4, "ip", [], -1.0)]
    total, with_segment, best = 0.0, np.zeros(len(segments)), (-1.0, ())
    for n in range(len(segments) + 1):
        for chosen in itertools.combinations(range(len(segments)), n):
            spans = sorted((segments[s][0], segments[s][1]) for s in chosen)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                score = sum(segments[s][4] for s in chosen)
                best = max(best, (score, chosen))
                total += np.exp(score)
                for s in chosen:
                    with_segment[s] += np.exp(score)
    assert np.allclose(pii._posteriors(4, segments), with_segment / total)
    assert tuple(sorted(pii.best_segments(4, segments))) == best[1]


def test_field_finds_held_out_layouts():
    w, right, wrong, there = pii.weights(), 0, 0, 0
    for text, spans in pii.training_regions(400, 991):
        base = pii.base_spans(text)
        missed = {s for s in spans if all(s[1] <= a or b <= s[0] for a, b, _ in base)}
        added = set(pii.added_spans(text, base, w))
        there, right, wrong = there + len(missed), right + len(added & missed), wrong + len(added - missed)
    assert right >= 0.5 * there
    assert wrong <= 0.25 * max(1, right)


def test_spaced_addresses_in_sentences():
    w = pii.weights()
    for name in ("bob", "anna.berg", "carl7", "d_smith42"):
        for head, tail in (("Please write to ", " before noon"), ("In 2024 ask ", ""), ("", ", thanks")):
            text = f"{head}{name} @example.com{tail}"
            assert pii.find(text, w)[1] == [(len(head), len(head) + len(name) + len(" @example.com"), "email")], text
    assert pii.find("see you @noon or meet the @team there", w)[1] == []


def test_long_regions_lose_nothing_at_cuts():
    w, phone = pii.weights(), "(555) 123-4567"
    for tokens_a_word, word in ((3, "11x "), (2, "7 ")):  # over each place of a cut by characters and of one by tokens
        for n in {*range(4096 // len(word) - 10, 4096 // len(word) + 3), *range(4096 // tokens_a_word - 10, 4096 // tokens_a_word + 3)}:
            head = "11x " * n if word != "7 " else "7 " * (n - 1) + "x1 "
            got = [s for s in pii.added_spans(head + phone + " 33z" + " 44y" * 3000, [], w) if s[2] == "phone"]
            assert got == [(len(head), len(head) + len(phone), "phone")], n


# --- op8


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 63, b"x" * 64, b"x" * 65, bytes(range(256)) * 30, "é日".encode() * 700])
def test_avi_round_trip(text):
    payload = media_avi.padded(text)
    assert payload.startswith(text) and len(payload) % 64 == 0 and len(payload) >= 64 and len(payload) - len(text) <= 64
    data = media_avi.write_avi(media_avi.store_frames(payload), 8 * media_avi.SIDE, 8 * media_avi.SIDE, comment=b"payload_bytes=%d" % len(payload))
    assert data[:4] == b"RIFF" and data[8:12] == b"AVI "
    media = media_avi.decode_media(data)
    assert media_avi.stored_payload(media) == payload
    assert media["shots"][0][0] == 0 and media["shots"][-1][1] == len(media["frames"])


def test_a_cut_is_found():
    dark, light = np.zeros((1, media_avi.BINS)), np.zeros((1, media_avi.BINS))
    dark[0, 0] = light[0, -1] = 1
    found = media_avi.shots(np.concatenate([np.repeat(dark, 9, 0), np.repeat(light, 6, 0)]))
    assert [(a, b) for a, b, _ in found] == [(0, 9), (9, 15)]
    assert media_avi.shots(np.zeros((0, media_avi.BINS))) == []


def coded_jpeg(blocks, factors, wide, high, restart):
    """A baseline JPEG of these quantised coefficients: blocks[c][row][column], scan order; every symbol has a code of nine bits."""
    bits, out, last, unit = "", b"", [0] * len(factors), 0

    def flush(bits):
        data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big") if bits else b""
        return data.replace(b"\xff", b"\xff\0")

    number = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    for y in range(high):
        for x in range(wide):
            for c, (h, v) in enumerate(factors):
                for b in range(h * v):
                    block = blocks[c][y * v + b // h][x * h + b % h]
                    step, last[c] = block[0] - last[c], block[0]
                    bits += f"{abs(step).bit_length():09b}" + number(step)
                    run = 0
                    for k in range(1, 64):
                        if not block[k]:
                            run += 1
                            continue
                        bits += f"{0xF0:09b}" * (run // 16) + f"{run % 16 << 4 | abs(block[k]).bit_length():09b}" + number(block[k])
                        run = 0
                    bits += f"{0:09b}" if run else ""
            unit += 1
            if restart and unit % restart == 0 and unit < wide * high:
                out, bits, last = out + flush(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]), "", [0] * len(factors)
    counts = bytes([0] * 8 + [0xF1 + 0] + [0] * 7)
    code = lambda kind: bytes([kind]) + counts + bytes(range(0xF1))
    across, down = max(h for h, _ in factors), max(v for _, v in factors)
    parts = b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors))
    scan = bytes([len(factors)]) + b"".join(bytes([c + 1, 0]) for c in range(len(factors))) + bytes([0, 63, 0])
    head = [(0xDB, bytes([0]) + bytes([3]) * 64), (0xC0, struct.pack(">BHHB", 8, 8 * down * high, 8 * across * wide, len(factors)) + parts), (0xC4, code(0) + code(16)), (0xDD, struct.pack(">H", restart)), (0xDA, scan)]
    return b"\xff\xd8" + b"".join(media_avi._segment(m, b) for m, b in head) + out + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("factors", "restart"), [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3)])
def test_coefficients_of_coded_frames(factors, restart):
    """Prediction, runs, runs over 16, ends of blocks, stuffed bytes, chroma and its subsampling, restarts."""
    r = random.Random(restart)
    wide, high = 3, 2
    block = lambda: [r.randint(-900, 900) if k == 0 else r.choice([0] * r.choice([1, 3, 30]) + [r.randint(-255, 255), -1, 1023]) for k in range(64)]
    blocks = [[[block() for _ in range(wide * h)] for _ in range(high * v)] for h, v in factors]
    data = coded_jpeg(blocks, factors, wide, high, restart)
    assert b"\xff\0" in data
    found = media_avi.luma_coefficients(media_avi.parse_jpeg(data))
    assert found.tolist() == [b for row in blocks[0] for b in row]


def test_long_scan_takes_linear_time():
    block = [5] + [7, 0, -3] * 21
    took = []
    for wide in (40, 400):
        data = coded_jpeg([[[block] * wide]], [(1, 1)], wide, 1, 0)
        began = time.process_time()
        assert len(media_avi.luma_coefficients(media_avi.parse_jpeg(data))) == wide
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.01)


def test_frames_by_any_index():
    """The old index, the OpenDML one inside the frames' list, and none at all."""
    frames = [media_avi.store_frames(bytes([k]) * 1024)[0] for k in range(3)]
    data = media_avi.write_avi(frames, 32, 32)
    body = lambda d: [d[a : a + n] for a, n in media_avi.read_avi(d)["frames"]]
    assert body(data) == frames
    cut = data.index(b"idx1")
    plain = data[:4] + struct.pack("<I", cut - 8) + data[8:cut]
    assert body(plain) == frames
    movi = plain.index(b"movi")
    entries = b"".join(struct.pack("<II", a - movi, n) for a, n in media_avi.read_avi(plain)["frames"])
    index = media_avi._chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", movi, 0) + entries)
    size = struct.unpack_from("<I", plain, movi - 4)[0]
    whole = plain[: movi - 4] + struct.pack("<I", size + len(index)) + plain[movi:] + index
    whole = whole[:4] + struct.pack("<I", len(whole) - 8) + whole[8:]
    assert body(whole) == frames


# --- op9


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    runs = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [*ODD, "one", "one two", "ONE two Three", "a b c d e f g", "É x y z"])
def test_fingerprint(text):
    got = simhash_dedup.majority_bits(simhash_dedup.shingle_hashes(text.encode().lower().split(), 3, 42))
    assert got % (1 << 64) == plain_fingerprint(text)


def test_thresholds_keep_the_pigeonhole():
    costs = [{-1: 0.0, 0: 5.0, 1: 100.0}, {-1: 0.0, 0: 7.0, 1: 9.0}, {-1: 0.0, 0: 50.0}]
    cost, chosen = simhash_dedup.allocate(2, costs)
    best = min(sum(c[t] for c, t in zip(costs, ts, strict=True)) for ts in itertools.product(*costs) if sum(t + 1 for t in ts) == 3)
    assert cost == best and sum(t + 1 for t in chosen) == 3


# --- op10


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    first, scores = np.array([0, 4, 4, 9]), rng.standard_normal((9, 3)) * 3
    got = language_id.viterbi(scores, first, 2.0)
    value = lambda path, a: sum(scores[a + k, x] for k, x in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            assert value(got[a:b].tolist(), a) == pytest.approx(max(value(p, a) for p in itertools.product(range(3), repeat=int(b - a))), abs=1e-5)


def test_scores_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    model = {"langs": ["a", "b", "c"], "log": rng.standard_normal((language_id.BUCKETS, 3)).astype(np.float32), "scripts": np.array([1, 1, 2], np.int32)}
    w = language_id.Words([b"some words here", b"", "und straße".encode() * 9, b"x" * 500])
    whole = language_id.word_scores(w, model)
    monkeypatch.setattr(language_id, "CELLS", 40)
    assert np.allclose(language_id.word_scores(w, model), whole, rtol=1e-5)


# --- shared


def test_token_hashes_tell_words_apart():
    t = ngrams.Tokens([b"one two  one", b"", b"two"], whole=True)
    assert len(t.hash) == 4 and t.hash[0] == t.hash[2] and t.hash[1] == t.hash[3] and t.hash[0] != t.hash[1]
    assert t.text.tolist() == [0, 0, 0, 2] and t.first.tolist() == [0, 3, 3, 4]


def test_best_cut_parts_the_labels():
    assert quality.best_cut([(0.0, 10, 0), (-1.0, 0, 10)]) == 0.0
    assert quality.best_cut([(0.0, 5, 0)]) <= 0.0


def test_crc_is_of_the_text():
    assert zlib.crc32(b"12") % 7 == zlib.crc32(str(12).encode()) % 7
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
