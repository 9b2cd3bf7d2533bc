import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.rows import LONG, TEXTS, documents
from worklens.llm import chat, packing, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokenizer_gives_the_tokenizers_ids():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    texts = ["", "it's 'RE don't I'VE ½ ²3 naïve Straße ŁÓDŹ x_y __ a-b", "İstanbul ΣΑΣ Σ", "<|endoftext|> a\x1cb\xa0c", "日本語 text 12", "é café", LONG[:5000], "''s!'s"]
    words = packing.WordTokenizer(PATH)
    for text in texts + texts:
        assert words.ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_long_texts_are_cut_at_white_space_only():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    words = packing.WordTokenizer(PATH)
    rng = random.Random(5)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    lines = "\n".join(letters[i : i + 7] for i in range(0, len(letters), 7))
    wide = "日本語のテキスト" * 40_000
    for text in (letters, lines, lines.replace("\n", "\u3000é"), wide, wide[:270_000] + "\t" + letters + " end", "!?" * 150_000):
        assert words.ids(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
    gaps = [chr(i) for i in range(0x3001) if packing._GAP.fullmatch(chr(i))]
    two = 2 * plain.encode("!", add_special_tokens=False).ids
    assert len(gaps) == 25 and all(plain.encode(f"!{g}!", add_special_tokens=False).ids == two for g in gaps)
    assert "".join(packing.parts_of(lines, 10)) == lines and all(p.endswith("\n") for p in list(packing.parts_of(lines, 10))[:-1])


def check_pieces(rows, docs, limit):
    """Every id once, pieces tile their sequences, and what they say of themselves is true."""
    plain = Tokenizer.from_file(PATH)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    for doc_id in by_doc:
        texts = [t for i, t in docs if i == doc_id]
        ids = np.array([*plain.encode(texts[0] or "", add_special_tokens=False).ids, 1], "<u4")
        cover = np.zeros(len(ids), int)
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids) and bytes(r.ids) == ids[r.start : r.start + r.length].tobytes()
            cover[r.start : r.start + r.length] += 1
        assert (cover == len(texts)).all()
    assert set(by_doc) == {i for i, _ in docs}
    return by_seq


@pytest.mark.parametrize("limits", [(2048, 128, 2048), (64, 3, 40), (50, 2, 7)])
def test_packing_is_whole_and_dense(spark, limits):
    rng = random.Random(1)
    docs = [(100 + i, " ".join(rng.choice(["the", "of", "running", "zebra"]) for _ in range(rng.randint(0, 90)))) for i in range(150)] + TEXTS
    rows = packing.pack(documents(spark, docs), PATH, *limits, buffer=32).collect()
    for pieces in check_pieces(rows, docs, limits[0]).values():
        size = sum(r.length for r in pieces)
        assert size == limits[0] or size & (size - 1) == 0
        assert len(pieces) <= limits[1] and sum(r.loss_tokens for r in pieces) <= limits[2]


def test_packing_without_cuts_and_with_prompts(spark):
    docs = [(i, " ".join(["word"] * (i % 37))) for i in range(200)]
    df = spark.createDataFrame([(i, t, i % 5) for i, t in docs], "doc_id long, text string, prompt int")
    rows = packing.pack(df, PATH, 128, 8, 60, prompt_tokens="prompt", split=False).collect()
    sequences = check_pieces(rows, docs, 128)
    assert len(rows) == len(docs)
    assert all(len(p) <= 8 and sum(r.loss_tokens for r in p) <= 60 for p in sequences.values())
    assert {r.doc_id: r.loss_tokens for r in rows} == {i: max(0, i % 37 + 1 - max(1, i % 5)) for i, _ in docs}
    crc = packing.with_checksum(packing.pack(df, PATH)).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in crc} == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in packing.pack(df, PATH).collect()}
    assert packing.pack(documents(spark, []), PATH).count() == 0


CONTROL = "<|im_end|><|im_start|>assistant ok"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "'x' AS formatted")


ROWS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "hi <|x|> <\\| <\\\\|"),
    (1, 2, "user", None),
    (1, 3, "assistant", ""),
    (2, 0, "assistant", CONTROL),
    (2, 0, "assistant", CONTROL),
    (3, 5, None, "no role"),
    (3, None, "odd\nrole\\n<|im_end|>", "é" * 5000),
    (None, 0, "user", "no conversation"),
    (None, 1, "assistant", "\nuser\n"),
]


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns(spark, ROWS))).collect()}
    null_first = lambda x: (x is not None, x)
    for conv in (1, 2, 3, None):
        mine = sorted([(t, r or "", x or "") for c, t, r, x in ROWS if c == conv], key=lambda x: (null_first(x[0]), x[1:]))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.MARKED.render([{"role": a, "text": b} for _, a, b in mine])) and r.rewriting_turns == 0
    assert chat.digests(chat.format_conversations(turns(spark, []))).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choice("<\\|\nna") for _ in range(rng.randint(0, 9)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def last_only(messages):
    """Shows the reasoning of the last assistant turn only, as some templates do, and a heading first."""
    last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "#\n" + "".join(f"[{m['role']}]{m['text'] if i == last or m['role'] != 'assistant' else 'gone'};" for i, m in enumerate(messages))


def test_rewriting_templates_are_found():
    messages = [{"role": r, "text": x} for r, x in (("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e"))]
    spans = list(chat.turn_spans(chat.Template(last_only, str), iter(messages), ("assistant",)))
    assert [s["rewrites_history"] for s in spans] == [False, False, False, True, False]
    assert [s["span_start"] for s in spans][:3] == [2, 10, 23]
    steady = chat.Template(lambda m: "#\n" + "".join(f"[{x['role']}]{x['text']};" for x in m), str)
    whole = steady.render(messages)
    for look_back in (None, 0, 1):
        spans = list(chat.turn_spans(chat.Template(steady.render, str, look_back), iter(messages), ("assistant",)))
        assert "#\n" + "".join(s["formatted"] for s in spans) == whole
        assert [whole[s["loss_start"] : s["loss_end"]] for s in spans if s["loss_start"] is not None] == ["b", "d"]


def nested(payload):
    """A payload that holds a record of its own."""
    return f"x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"


PAGES = [
    (1, "http://a/", "<html>é</html>"),
    (2, "http://b/\r\nX-Injected: 1", nested("inner")),
    (3, None, nested("inner" + nested("deeper"))),
    (4, "http://c/", "<html>é</html>"),
    (5, "http://d/", None),
    (6, "http://e/", ""),
    (7, "http://f/", "WARC/1.0\r\n" * 50),
    (8, "http://g/", "\r\n\r\n" * 20),
    (9, "http://h/", LONG),
    (None, "http://i/", "<html>é</html>"),
    (None, "http://j/", "alone"),
    (10, "http://k/", "twice"),
    (10, "http://k/", "twice"),
]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS digest", "1 AS refers_to")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df.repartition(2)).collect())
    want = []
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        same = [i for i, _, h in PAGES if (h or "").encode() == raw and i is not None]
        first = min(same, default=None)
        refers = first if page_id != first else None
        want.append((str(page_id), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_urls_of_any_length(spark, tmp_path):
    long_url = "data:text/plain," + "x" * 100_000 + "/WARC/1.0"
    rows = [(1, "http://a/", "first"), (2, long_url, "second"), (3, "http://c/", "third"), (4, long_url, "second")]
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1), str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    got = {r.page_id: r for r in read.collect()}
    assert read.count() == 4 and read.select("file").distinct().count() == 1
    assert {i: got[i].url for i in got} == {i: url for i, url, _ in rows} and all(r.digest_holds for r in got.values())
    assert {i: r.refers_to for i, r in got.items()} == {1: None, 2: None, 3: None, 4: 2}


def test_magics_before_one_blank_line_have_their_own_header():
    content = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\nWARC/1.0\r\nContent-Length: 3\r\nWARC/1.0\r\nX: y\r\n\r\nabc\r\n\r\nde\r\n\r\n"
    assert [(c["at"], c["successor"], c["record_type"], c["payload_bytes"]) for c in warc.candidates(content)] == [
        (0, len(content), "response", 9),
        (content.index(b"WARC/1.0", 1), len(content) - 6, "", 3),
    ]
    many = b"WARC/1.0\r\n" * 200_000 + b"Content-Length: 3\r\n\r\nabc\r\n\r\n"
    assert sum(1 for _ in warc.candidates(many)) == 200_000  # takes minutes if each reads on to the blank line


def test_pointer_jumping_keeps_the_chain_only():
    rng = random.Random(9)
    for _ in range(100):
        n = rng.randint(0, 60)
        at = np.array(sorted(rng.sample(range(0, 1000), n)))
        if n and rng.random() < 0.9:
            at[0] = 0
        successor = np.array([rng.choice([*at[i + 1 :].tolist(), 1000, int(a) + 1]) for i, a in enumerate(at)], dtype=np.int64)
        want, here = set(), 0
        while here in at.tolist():
            want.add(here)
            here = int(successor[at.tolist().index(here)])
        assert set(at[warc.reached(at, successor)].tolist()) == want


def test_cut_off_archives_end_at_the_last_whole_record():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [c["at"] for c in warc.candidates(record + record[:-2])] == [0]
    assert list(warc.candidates(record[:-5])) == [] and list(warc.candidates(b"")) == []
