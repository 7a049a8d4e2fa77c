"""The operators as Spark jobs: odd rows, empty tables, further columns, brute-force and SQL counterparts."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SMALL, rows_of, rows_of_sql
from pyspark.sql import functions as F

from epochlens.llm import chat_tools, decontaminate, language_id, lm_scoring, media_avi, ngrams, pii, quality, sentencepiece_codec, simhash_dedup, warc
from epochlens.llm.common import materialised, table, work_path

LONG = " ".join(f"word{k % 977} mail{k}@example.com" for k in range(20_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same few words stand here"), (6, "the same few words stand here"), (6, "the same few words stand here"), (None, "no id 4111 1111 1111 1111"), (7, "é 日本 +1 (555) 123-4567")]
#: Further columns under names that the operators use themselves.
CLASHING = ["id", "fp", "row", "t", "keys", "page", "word", "component", "key", "matches", "_t"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_warc_odd_pages(spark):
    rows = [(1, "u1", None), (2, "u2", "x" * 200), (3, "u3", "x" * 200), (4, None, "small"), (5, "u\r\n5", "small"), (6, "u6", "é" * 60), (7, "u7", "é" * 60), (8, "u8", "\x1f\u008b\x08 no gzip" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    files = warc.write_warc(pages, work_path(spark, "warc-test"))
    for split in (97, 1 << 20):
        found = {r["record_id"]: r for r in warc.read_warc(files, split_bytes=split).collect()}
        assert len(found) == len(rows)
        for i, _, html in rows:
            payload, r = (html or "").encode(), found[f"urn:page:{i}"]
            first = min(j for j, _, h in rows if (h or "") == (html or ""))
            revisit = len(payload) >= 100 and first != i
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == hashlib.sha256(payload).hexdigest()
            assert (r["record_type"], r["refers_to"]) == (("revisit", f"urn:page:{first}") if revisit else ("response", None))
            assert (None if r["payload"] is None else bytes(r["payload"])) == (None if revisit else payload)
    empty = warc.write_warc(pages.where("false"), work_path(spark, "warc-test"))
    assert warc.read_warc(empty).count() == 0


def test_warc_keeps_all_payloads_of_an_id(spark):
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(1, "u1", a), (5, "u5", a), (5, "u5", b), (5, "u5", b), (5, "u5", "short"), (7, "u7", b), (7, "u7", c), (None, "n", c), (None, "n", "d" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = warc.read_warc(warc.write_warc(pages, work_path(spark, "warc-test"))).collect()
    text = lambda r: None if r["payload"] is None else bytes(r["payload"]).decode()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r["record_id"], r["payload_digest"], r["refers_to"] or "", text(r) or "") for r in found)
    kept = [(f"urn:page:{i}", digest(s), "", s) for i, s in [(1, a), (5, b), (5, b), (5, "short"), (7, c), ("", c), ("", "d" * 150)]]
    assert got == sorted([*kept, ("urn:page:5", digest(a), "urn:page:1", ""), ("urn:page:7", digest(b), "urn:page:5", "")])


def test_a_record_inside_a_record_is_no_record(spark, tmp_path):
    """A member stored uncompressed inside another one's data, read in ranges that start between the two."""
    inner = warc.record_bytes("inner", "u", b"x" * 50, None)
    body = b"HTTP/1.1 200 OK\r\n\r\n" + random.Random(1).randbytes(300) + inner + random.Random(2).randbytes(300)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <outer>\r\nContent-Length: %d\r\n\r\n" % len(body)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(head + body + b"\r\n\r\n") + packer.flush()
    assert inner in outer
    for tail in (b"", warc.record_bytes("last", "u", b"y" * 500, None)):
        (tmp_path / "a.warc.gz").write_bytes(warc.record_bytes("first", "u", b"z" * 500, None) + outer + tail)
        files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", (tmp_path / "a.warc.gz").stat().st_size)], "path string, size long")
        for split in (64, 200, 300, 1 << 20):
            found = warc.read_warc(files, split_bytes=split)
            assert sorted(r["record_id"] for r in found.collect()) == sorted(["urn:page:first", "outer", *(["urn:page:last"] if tail else [])])
    assert warc.header_of(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nshort") is None
    assert warc.header_of(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n") is None


def test_damaged_archives_read_alike_in_all_ranges(spark, tmp_path):
    """Damaged, cut off and foreign members anywhere: every cut gives what one scan gives, and only the damaged records are missing."""
    r = random.Random(5)
    members = [warc.record_bytes(str(i), f"u{i}", r.randbytes(r.randrange(20, 400)), None) for i in range(9)]
    broken = {2: members[2][:-30], 5: members[5][:40] + b"\xff\xff\xff" + members[5][43:], 8: members[8][: len(members[8]) // 2]}
    noise = {3: b"\x1f\x8b\x08 no member", 6: gzip.compress(b"no record at all")}
    (tmp_path / "d.warc.gz").write_bytes(b"".join(broken.get(i, m) + noise.get(i, b"") for i, m in enumerate(members)))
    files = spark.createDataFrame([(f"file://{tmp_path}/d.warc.gz", (tmp_path / "d.warc.gz").stat().st_size)], "path string, size long")
    want = [f"urn:page:{i}" for i in range(9) if i not in broken]
    for split in (50, 333, 700, 1 << 20):
        found = warc.read_warc(files, split_bytes=split).collect()
        assert sorted(x["record_id"] for x in found) == want and len({x["offset"] for x in found}) == len(want)


def test_warc_equals_sql(spark):
    assert rows_of(warc.op1_warc(spark, SMALL)) == rows_of_sql(warc.OP1_SQL, SMALL)


def test_quality_without_labels_keeps_all(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.resample(odd, labels).where("kept").count() == len(TEXTS)
    assert quality.resample(none, labels).count() == 0
    assert quality.keep_drawn(odd, labels).columns == odd.columns


def test_quality_parts_junk(spark):
    r = random.Random(8)
    good, bad = [f"good{k}" for k in range(60)], [f"junk{k}" for k in range(60)]
    docs = [(k, " ".join(r.choice(bad if k % 4 == 0 else good) for _ in range(80))) for k in range(2000)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 2000, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {x["id"]: x["kept"] for x in quality.resample(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    assert sum(found[k] == (k % 4 != 0) for k, _ in docs) >= 1980


def test_least_key_has_the_top_above_it(spark):
    r = random.Random(3)
    rows = [(k, r.choice([0.5, 1.5, r.uniform(-50, 5000)])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, key double")
    for k in (1, 77, 499, 500):
        cut, top = quality.least_key(df, "key", k), sorted((x for _, x in rows), reverse=True)[k - 1]
        assert top - 2 * quality.KEY_STEP <= cut <= top or (k == 500 and cut == float("-inf"))


def test_weights_equal_plain_counting(spark):
    """log_weight is the ratio of two probabilities over every occurrence; kept and drawn follow from penalty and key."""
    docs = [(x["doc_id"], x["text"]) for x in table(spark, SMALL, "documents").collect()][:120] + [(None, "a a a b"), (7000, None), (7001, "")]
    labels = [(x["doc_id"], x["quality"], x["toxic"]) for x in table(spark, SMALL, "labels").collect()]
    is_target = {i: q == 1 and (t or 0) != 1 for i, q, t in labels}
    raw, target = ({}, {}), ({}, {})
    held = []
    for i, t in docs:
        *_, cells, _ = quality._buckets([(t or "").encode()])
        kinds = [[c for c in cells.tolist() if c >> quality.BITS == k] for k in (0, 1)]
        held.append(kinds)
        for k in (0, 1):
            for c in kinds[k]:
                raw[k][c] = raw[k].get(c, 0) + 1
                target[k][c] = target[k].get(c, 0) + bool(is_target.get(i))
    n, totals = 1 << quality.BITS, [(sum(raw[k].values()), sum(target[k].values())) for k in (0, 1)]

    def ratio(k, c):
        p = (raw[k].get(c, 0) + 1) / (totals[k][0] + n)
        return float(np.log((target[k].get(c, 0) + n * p) / (totals[k][1] + n) / p))

    wanted = [sum(ratio(k, c) for k in (0, 1) for c in kinds[k]) for kinds in held]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = quality.resample(rows, table(spark, SMALL, "labels"), share=0.5).collect()
    by_id = {x["id"]: x for x in found}
    assert [by_id[i]["log_weight"] for i, _ in docs] == pytest.approx(wanted, rel=1e-4, abs=1e-4)
    kept = sorted((x["key"] for x in found if x["kept"]), reverse=True)
    assert sorted((x["key"] for x in found if x["drawn"]), reverse=True) == kept[: round(0.5 * len(kept))]
    assert not any(x["drawn"] and not x["kept"] for x in found)
    assert quality.resample(rows.where("false"), table(spark, SMALL, "labels"), share=0.5).count() == 0


def test_encoding_of_odd_rows(spark, odd, none, model):
    found = by_id(sentencepiece_codec.encoded_digests(odd, model))
    c = sentencepiece_codec.codec(model)
    wanted = []
    for i, t in TEXTS:
        ids = c.model.encode(t or "", add_bos=True, add_eos=True)
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        wanted.append((i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(c.model.decode(ids).encode()).hexdigest(), len((t or "").encode()), True))
    assert found == sorted(wanted, key=repr)
    assert sentencepiece_codec.encoded_digests(none, model).count() == 0


def test_scores_of_odd_rows(spark, odd, none, model):
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    found = lm_scoring.score_texts(odd.where("doc_id is not null"), train, model).orderBy("doc_id").collect()
    known = [(i, t) for i, t in TEXTS if i is not None]
    wanted = sorted(zip([i for i, _ in known], lm_scoring.brute_force_base([i for i, _ in known], [t for _, t in known]), strict=True))
    assert [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found] == [(i, *w[:3]) for i, w in wanted]
    assert all(r["base_score"] == pytest.approx(w[3], rel=1e-9) for r, (_, w) in zip(found, wanted, strict=True))
    assert all(r["score"] < 0 for r in found)
    assert lm_scoring.score_texts(none, train, model).count() == 0
    assert lm_scoring.score_texts(odd, F.lit(False), model).where("n_known <> 0 or train_tokens <> 0").count() == 0


def test_base_scores_of_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    found = {r["doc_id"]: r for r in lm_scoring.op4_lm_scoring(spark, SMALL).collect()}
    for (i, _), (n, known, total, base) in zip(docs, lm_scoring.brute_force_base([i for i, _ in docs], [t for _, t in docs]), strict=True):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def plain_model_scores(docs, path):
    """score of each text, in one process: one pass over all texts a round."""
    c = sentencepiece_codec.codec(path)
    low = ["".join(x.lower() if x.isascii() else x for x in t or "") for _, t in docs]
    ids = [np.array(c.model.encode(t, add_eos=True), np.int64) for t in low]
    trained = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs]
    classes = lm_scoring.Classes(np.bincount(np.concatenate([x for x, y in zip(ids, trained, strict=True) if y]), minlength=c.model.get_piece_size()))
    pairs = np.zeros((classes.n + 1, classes.n))
    for x, y in zip(ids, trained, strict=True):
        for a, b in zip([classes.n, *classes.of[x]], classes.of[x], strict=False) if y else ():
            pairs[a, b] += 1
    adam = lm_scoring.Adam(lm_scoring.initial(classes, pairs))
    for k in range(lm_scoring.ROUNDS):
        total, n = np.zeros(lm_scoring.SIZE), 0
        for (_, t), x, y in zip(docs, ids, trained, strict=True):
            if y and zlib.crc32(hashlib.md5((t or "").encode()).digest()) % lm_scoring.ROUNDS == k and len(x):
                windows = lm_scoring.training_windows(classes.of[x], np.array([0, len(x)]))
                total += lm_scoring.gradient(lm_scoring.parts(adam.flat.astype(np.float32)), *windows)[1]
                n += len(x)
        if n:
            adam.step(total / n)
    p, log_share = lm_scoring.parts(adam.flat.astype(np.float32)), np.log10(classes.share)
    return [float(lm_scoring.scores(p, x, np.array([0, len(x)]), classes)[0]) for x in ids], [float((classes.within[x] + log_share[classes.of[x]]).sum()) for x in ids], trained


def test_model_scores_of_a_whole_table(spark, model):
    """Equal to one process however the rows are dealt, and better than the ids' frequencies on texts held out."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    wanted, frequencies, trained = plain_model_scores(plain, model)
    held_out = [k for k, x in enumerate(trained) if not x]
    assert sum(wanted[k] for k in held_out) > 0.97 * sum(frequencies[k] for k in held_out)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    for tasks in (1, 7):
        found = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs.repartition(tasks), train, model).collect()}
        assert [found[i] for i, _ in plain] == pytest.approx(wanted, rel=1e-4, abs=1e-3)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the same few words stand here"), (2, None), (3, ""), (None, "no id"), (4, "an item that nobody holds at all")], "item_id long, text string")
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == ["1", "2", "3", "4", "7", "None"]
    assert decontaminate.clean(none, items).count() == 0
    assert decontaminate.clean(odd, items.where("false")).count() == len(TEXTS)


def test_tool_calls_equal_sql(spark):
    assert rows_of(chat_tools.op6_chat_tools(spark, SMALL)) == rows_of_sql(chat_tools.OP6_SQL, SMALL)


def test_tool_calls_of_odd_rows(spark):
    calls = spark.createDataFrame(
        [(1, "a", None, 0, "reply", '{"turn":0,"text":"x","chars":1}'), (1, "b", "a", 2, "reply", '{"text":7}'), (1, "c", "c", 3, "nope", "{}"), (1, "p", "q", 4, "reply", "no json"), (1, "q", "p", 5, "reply", None), (1, None, None, 6, None, "[1]"), (1, "z", "missing", 7, "reply", '{"turn":1,"text":"x","chars":301}')],
        "conv_id long, call_id string, after string, turn int, name string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", 9, "late"), (1, "a", 1, 'say "x"\n'), (1, "lost", 3, None), (1, None, 4, "y")], "conv_id long, call_id string, turn int, content string")
    found = {(r["call_id"], r["status"]): r for r in chat_tools.link_tool_calls(calls, results, chat_tools.REPLY).collect()}
    assert {k: found[k]["level"] for k in found if k[1] != "orphan"} == {("a", "linked"): 0, ("b", "unanswered"): 1, ("c", "unanswered"): 0, ("p", "cycle"): None, ("q", "cycle"): None, (None, "unanswered"): None, ("z", "unanswered"): 0}
    assert found["a", "linked"]["valid"] and found["a", "linked"]["canonical"] == '{"arguments":{"chars":1,"text":"x","turn":0},"id":"a","name":"reply","result":"say \\"x\\"\\n"}'
    assert found["b", "unanswered"]["errors"] == "chars: missing; text: not string; turn: missing"
    assert found["c", "unanswered"]["errors"] == "tool" and found["p", "cycle"]["errors"] == "arguments" and found["z", "unanswered"]["errors"] == "chars: over 300"
    assert {k[0] for k in found if k[1] == "orphan"} == {"lost", None}
    assert chat_tools.link_tool_calls(calls.where("false"), results.where("false"), chat_tools.REPLY).count() == 0


def test_personal_data_of_odd_rows(spark, odd, none):
    found = {r["doc_id"]: r for r in pii.personal_data(odd).collect()}
    assert [len(found[k]["base"]) for k in (1, 2, 3, 4, None, 7)] == [0, 0, 0, 20_000, 1, 1]
    masked = pii.redact(odd)
    assert masked.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in masked.select("doc_id", "text").collect()}
    assert texts[1] is None and texts[2] == "" and texts[None] == "no id [CARD]" and texts[7] == "é 日本 [PHONE]" and "@" not in texts[4]
    assert pii.personal_data(none).count() == 0


def test_media_of_odd_rows(spark, odd, none):
    found = by_id(media_avi.avi_features(media_avi.texts_as_avi(odd)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    wanted = []
    for i, t in TEXTS:
        data = (t or "").encode()
        payload = data + bytes((-len(data)) % 64 if data else 64)
        wanted.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert found == sorted(wanted, key=repr)
    assert media_avi.avi_features(media_avi.texts_as_avi(none)).count() == 0
    clips = media_avi.avi_clips(media_avi.texts_as_avi(odd))
    assert clips.where("end_s <= start_s").count() == 0 and clips.count() >= len(TEXTS)
    broken = spark.createDataFrame([(1, b"RIFFxx"), (2, None)], "doc_id long, media binary").withColumn("n_bytes", F.lit(0).cast("long"))
    assert media_avi.avi_features(broken).where("payload_sha256 is null").count() == 2 and media_avi.avi_clips(broken).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_all_pairs(spark, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(8)]
    prints = [r.getrandbits(64) for _ in range(60)]
    for k in range(400):  # one centre in ten holds a large crowd
        c = centres[0] if k % 2 else r.choice(centres)
        for b in r.sample(range(64), r.randint(0, 4)):
            c ^= 1 << b
        prints.append(c)
    prints += prints[:10] + [0, 0, 3, 2**64 - 1]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash_dedup.near_components(spark.createDataFrame(list(enumerate(signed)), "id long, fp long"), k=2)
    assert {x["id"]: x["component"] for x in found.collect()} == simhash_dedup.brute_force_components(list(range(len(signed))), signed)


@pytest.mark.parametrize("thresholds", [(1, -1, 0), (0, 1), (0, -1, 1)])
def test_links_with_unequal_thresholds(spark, thresholds):
    """Parts that hold bit 63 are searched with a threshold of 1, small groups and a large one."""
    r = random.Random(9)
    order = list(range(64)) if thresholds[-1] == 1 else list(range(63, -1, -1))
    masks = simhash_dedup.cut(order, len(thresholds))
    plan = [(m, t) for m, t in zip(masks, thresholds, strict=True) if t >= 0]
    assert any(m < 0 and t == 1 for m, t in plan)
    skipped = {b for m, t in zip(masks, thresholds, strict=True) if t < 0 for b in simhash_dedup.bits_of(m)}
    k = sum(t + 1 for t in thresholds) - 1
    centres, prints = [r.getrandbits(64) for _ in range(12)], set()
    for n in range(300):
        c = centres[0] if n % 3 == 0 else r.choice(centres)
        for b in r.sample([63, 62, *range(64)], r.randint(0, 3)):
            c ^= 1 << b
        prints.add(c)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    found = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long"), plan, k).collect()
    roots = {n: n for n in signed}

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2 * k
        x, y = root(a), root(b)
        roots[max(x, y)] = min(x, y)
    assert {n: root(n) for n in signed} == simhash_dedup.brute_force_components(signed, signed, k)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    r = random.Random(4)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    far = [w if k % 4 else f"z{k}" for k, w in enumerate(base)]
    more = spark.createDataFrame([(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(far))], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    kept = simhash_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(x["doc_id"]) for x in kept.select("doc_id").collect()) == sorted(["1", "20", "22", "4", "5", "7", "None"])
    assert simhash_dedup.first_of_each(none).count() == 0


def plain_near_duplicates(docs):
    """Ids that stay, by comparing every pair of texts that share a shingle."""
    sets = {}
    for _, t in docs:
        words = (t or "").encode().lower().split()
        sets[t or ""] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    names, holders = list(sets), {}
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n in names:
        for s in sets[n] or {None}:
            holders.setdefault(s, []).append(n)
    for pair in {(a, b) for held in holders.values() for k, a in enumerate(held) for b in held[:k]}:
        a, b = (sets[x] for x in pair)
        if len(a & b) >= 0.8 * len(a | b):
            x, y = map(find, pair)
            root[x] = y
    least = {}
    for i, t in docs:
        least[find(t or "")] = min(least.get(find(t or ""), i), i)
    return sorted(least.values())


def test_near_duplicates_equal_all_pairs(spark):
    """Families of every similarity, one of them over SMALL_GROUP and one large group that mixes families over shared words."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts, shared = [], [word() for _ in range(160)]
    for family in range(60):
        base = [word() for _ in range(r.randint(8, 220))] if family % 3 else [*shared, *(word() for _ in range(r.randint(20, 60)))]
        for _ in range(60 if family == 1 else 4):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 45))):
                copy.insert(r.randrange(len(copy) + 1), word())
            texts.append(" ".join([*(word() for _ in range(r.choice([0, 0, len(base) // 12]))), *copy]))
    docs = [(k, t) for k, t in enumerate(texts + texts[:20] + ["", None, " ", "one two"])]
    kept = sorted(x["doc_id"] for x in simhash_dedup.first_of_each(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert kept == plain_near_duplicates(docs)
    some = [(x["doc_id"], x["text"]) for x in table(spark, SMALL, "documents").collect()]
    assert sorted(x["doc_id"] for x in simhash_dedup.first_of_each(table(spark, SMALL, "documents")).collect()) == plain_near_duplicates(some)


def test_parts_find_alike_texts():
    """Recall of the parts and of the bits over pairs at the least similarity."""
    r, found, plausible = np.random.default_rng(3), 0, 0
    for _ in range(400):
        both, a, b = r.integers(0, 1 << 63, 240, dtype=np.uint64), r.integers(0, 1 << 63, 30, dtype=np.uint64), r.integers(0, 1 << 63, 30, dtype=np.uint64)
        least = simhash_dedup.smallest_hashes(np.concatenate([both, a, both, b]), np.array([0, 270, 540]))
        same = least[0] == least[1]
        found += any(same[[p + k * simhash_dedup.PARTS for k in range(simhash_dedup.PART_SIZE)]].all() for p in range(simhash_dedup.PARTS))
        plausible += int(((least[0] ^ least[1]) & np.uint64(1)).sum()) <= simhash_dedup.MOST_BITS
    assert found >= 396 and plausible >= 399


def test_languages(spark, odd, none):
    model = language_id.learn(odd.where("false"))
    assert {r["lang_pred"] for r in language_id.predict_spans(odd, model).collect()} == {"und"}
    docs = table(spark, SMALL, "documents")
    found = language_id.op10_language_id(spark, SMALL).join(docs.select("doc_id", "lang", "text"), "doc_id")
    held = found.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.9 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0
    learned = language_id.learn(docs)
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict_spans(odd, learned).collect() if r["doc_id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert language_id.predict_spans(none, learned).count() == 0


def test_language_spans(spark):
    """Mixed, very long and repeated texts: spans lie one after the other, and each part has its language."""
    docs = table(spark, SMALL, "documents").where("text is not null and lang is not null")
    model = language_id.learn(docs)
    whole = {x["lang"]: x["text"] for x in docs.orderBy("n_chars").collect()}
    a, b = sorted(whole)[:2]
    one, two = (" ".join(whole[x].split()[:80]) for x in (a, b))
    rows = [(1, f"{one} {two}"), (2, f"{one} {two}"), (3, f"{one} " * 2000), (4, two), (None, two)]
    found = {x["doc_id"]: x for x in language_id.predict_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    texts = {i: t.encode() for i, t in rows}
    for i, x in found.items():
        spans = [(s["start"], s["end"], s["lang"]) for s in x["spans"]]
        assert all(s < e for s, e, _ in spans) and all(p[1] < q[0] and p[2] != q[2] for p, q in zip(spans, spans[1:], strict=False))
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[i].rstrip())
    assert {s["lang"] for s in found[1]["spans"]} >= {a, b} and found[1]["spans"] == found[2]["spans"]
    assert found[3]["lang_pred"] == a and found[4]["lang_pred"] == b and found[4]["spans"] == found[None]["spans"]
    cut = next(s["end"] for s in found[1]["spans"] if s["lang"] == a)
    assert abs(cut - len(one.encode())) < 80


def test_pipeline_stages_equal_plain_versions(spark, model):
    """Each stage on its own input, in order, on a whole table."""
    import corpus_pipeline

    stages, docs = dict(corpus_pipeline.STAGES), table(spark, SMALL, "documents")
    found = {x["id"]: x["kept"] for x in quality.resample(docs, table(spark, SMALL, "labels")).collect()}
    kept = materialised(stages["quality"](spark, docs, SMALL), "test")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(k for k, v in found.items() if v)
    rows = [(x["doc_id"], x["text"]) for x in kept.collect()]
    once = materialised(stages["near_duplicates"](spark, kept, SMALL), "test")
    assert sorted(x["doc_id"] for x in once.collect()) == plain_near_duplicates(rows)
    words = lambda t: ngrams.Tokens(decontaminate.folded([t]), fold=True, marks=False).hash
    items, wanted = [words(x["text"]) for x in table(spark, SMALL, "benchmark").collect()], []
    for x in once.collect():
        held = words(x["text"])
        near = False
        for item in items:
            most = int(decontaminate.ERROR_RATE * len(item))
            if len(item) and len({*item.tolist()} - {*held.tolist()}) <= most:  # each word that isn't there costs an edit
                near = near or decontaminate.aligned(item, held)[0] <= most
        if not near:
            wanted.append(x["doc_id"])
    clean = materialised(stages["decontamination"](spark, once, SMALL), "test")
    assert sorted(x["doc_id"] for x in clean.collect()) == sorted(wanted)
    before, after = ({x["doc_id"]: x["text"] for x in d.collect()} for d in (clean, stages["personal_data"](spark, clean, SMALL)))
    w = pii.weights()
    for i, t in before.items():
        marked = list(t or "")
        for a, b, kind in reversed(pii.find(t or "", w)[1]):
            marked[a:b] = [f"[{kind.upper()}]"]
        spans = pii.find(t or "", w)[1]
        if all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)):
            assert (after[i] or "") == "".join(marked)
    c = sentencepiece_codec.codec(model)
    for x in corpus_pipeline.run(spark, SMALL).collect():
        assert x["ids"] == c.model.encode(after[x["doc_id"]] or "", add_bos=True, add_eos=True) and x["n_tokens"] == len(x["ids"])


def test_pipeline(spark, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    found = corpus_pipeline.run(spark, SMALL)
    docs = table(spark, SMALL, "documents").select("doc_id")
    assert 0 < found.count() <= docs.count() and found.join(docs, "doc_id", "left_anti").count() == 0
    now = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count() <= len(TEXTS)


def test_near_duplicate_stage_searches_by_simhash(spark, monkeypatch):
    """The stage's first candidates are the pairs within two bits of SimHash, found by the pigeonhole plan; their shingles confirm them."""
    r = random.Random(5)
    texts = []
    for _ in range(25):
        words = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(50)) for _ in range(400)]
        other = list(words)
        other[r.randrange(400)] = "new"
        texts += [" ".join(words), " ".join(other)]
    seen, real = [], simhash_dedup._simhash_pairs
    monkeypatch.setattr(simhash_dedup, "_simhash_pairs", lambda distinct: (seen.append(distinct), real(distinct))[1])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash_dedup.first_of_each(docs).collect()) == list(range(0, 50, 2))
    of = {bytes(x["t"]): x["fp"] for x in seen[0].collect()}
    assert sorted(of.values()) == sorted(x["fp"] for x in simhash_dedup.fingerprints(docs).collect())
    found = {frozenset((bytes(x["a"]), bytes(x["b"]))) for x in real(seen[0]).collect()}
    near = {frozenset((a, b)) for a in of for b in of if a < b and ((of[a] ^ of[b]) & (2**64 - 1)).bit_count() <= 2}
    assert near and found == near


def test_pipeline_stages_give_python_small_batches(spark):
    """A stage's result comes through Python in batches of BATCH_ROWS at most, though it is asked for after the stage has returned."""
    import pyarrow as pa

    import corpus_pipeline

    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        corpus_pipeline.pii_stage(spark, table(spark, SMALL, "documents"), SMALL)
        sizes = spark.range(5000).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert max(x["n"] for x in sizes) <= corpus_pipeline.BATCH_ROWS and sum(x["n"] for x in sizes) == 5000
        assert spark.conf.get(names[0]).rstrip("bB") == str(corpus_pipeline.BATCH_BYTES)
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)


def test_counts_of_models_come_in_few_jobs(spark):
    """Not a job for each shuffle partition."""
    docs = spark.createDataFrame([(f"some words of text {k} and more", k % 3 == 0) for k in range(200)], "text string, target boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = quality.count_models(docs)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("counts", "counts")
    try:
        many = quality.count_models(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (one == many).all() and one.any()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counts")) <= 2 * quality.PIECES


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)"])
def test_every_label_counts(spark, monkeypatch, kind):
    """However few labels are sent to all tasks: models, weights and the cut are those of all labels."""
    docs = table(spark, SMALL, "documents").select(F.when(F.col("doc_id") % 41 != 0, F.col("doc_id")).cast(kind).alias("doc_id"), "text")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))
    labels = table(spark, SMALL, "labels").withColumn("doc_id", F.col("doc_id").cast("long"))
    columns = ["id", "log_weight", "penalty", "kept", "drawn"]
    result = lambda: sorted(map(repr, quality.resample(docs, labels, share=0.5).select(*columns).collect()))
    whole, stage = result(), sorted(map(repr, quality.keep_drawn(docs, labels).collect()))
    for name in ("SENT_LABELS", "MAX_LABELS"):
        monkeypatch.setattr(quality, name, 20, raising=False)
    assert result() == whole and sorted(map(repr, quality.keep_drawn(docs, labels).collect())) == stage


def test_bitmap_of_ids_misses_none(spark, monkeypatch):
    """True of every id asked for, and of few others; false of all where there are none."""
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(quality, "ID_BITS", bits)
        ids = spark.range(0, 6000, 3)
        found = spark.range(6000).select("id", quality.may_be_in(ids).alias("may")).collect()
        assert all(r["may"] for r in found if r["id"] % 3 == 0) and sum(r["may"] for r in found) <= (2010 if bits > 1 << 20 else 3000)
        assert not any(r["may"] for r in spark.range(100).select(quality.may_be_in(ids.where("false")).alias("may")).collect())
