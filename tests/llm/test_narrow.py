"""Chat formatting, token counts and the Ogg column against plain versions."""

import hashlib
import random
import zlib

import pytest

from tessella.llm import chat, ogg, tokens

DOCS = [(1, "plain text"), (2, None), (3, ""), (4, "é" * 5000 + " x"), (5, "plain text"), (None, "no id"), (6, "a" * 200_000)]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, media string")


def test_ogg_round_trip():
    r = random.Random(1)
    for n in (0, 1, 254, 255, 256, 575, 576, 577, 1152, 60_000, 200_000):
        data = r.randbytes(n)
        made = ogg.encode(data)
        sound = ogg.decode(made)
        assert sound.payload[:n] == data and set(sound.payload[n:]) <= {255}
        assert len(sound.payload) % 576 == 0 and len(sound.payload) >= 576
        assert sound.stamps[-1] == len(sound.payload) / 8000
    for size in (0, 254, 255, 510, 65_025, 65_026, 130_050, 200_000):
        packets = [(b"h", 0), (b"x" * size, 5), (b"y", 6)]
        found = ogg.demultiplex(b"".join(ogg.paginate(packets, 9)))
        assert [p.data for p in found[9]] == [p for p, _ in packets]


def test_ogg_checksum_is_the_bitwise_one():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        return crc & 0xFFFFFFFF

    for data in (b"", b"a", bytes(range(256))):
        assert ogg.checksum(data) == slow(data)
    made = bytearray(ogg.encode(b"hello"))
    made[-1] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(made))


def test_ogg_rows(spark):
    rows = ogg.media_digests(docs(spark, DOCS)).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    for i, t in DOCS:
        data = (t or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (by[i].n_bytes, by[i].payload_bytes) == (len(data), len(padded))
        assert by[i].payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert by[i].tail_crc32 == zlib.crc32(padded[-32:])
    assert by[1].media_sha256 == by[5].media_sha256 and by[1].feature == by[5].feature
    assert ogg.media_digests(docs(spark, [])).count() == 0


def test_chat_escapes():
    r = random.Random(2)
    bits = [*chat.CONTROL, "\\", "<", ">", "|", "\n", "im_end", "a"]
    for _ in range(500):
        turns = [("".join(r.choices(bits, k=2)), "".join(r.choices(bits, k=6))) for _ in range(3)]
        text = "".join(chat.render(*t)[0] for t in turns)
        assert chat.parse(text) == turns
        assert not any(c in chat.escape(turns[0][1]) for c in chat.CONTROL)


def test_chat_rows(spark):
    told = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>x"), (1, 2, "user", None), (1, 3, "assistant", "y"), (1, 4, "user", "end"), (2, 0, "user", "only"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*t, 1) for t in told], "conv_id long, turn long, role string, text string, example int")
    assert chat.format_chat(df).where("conv_id = 1").count() == 3
    by = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    want = {}
    for c in (1, 2, 3, None):
        rows = sorted(((t, r or "", x or "") for i, t, r, x in told if i == c), key=str)
        want[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest(), "".join(x for _, r, x in rows if r == "assistant"))
    for c, (n, digest, loss) in want.items():
        assert (by[c].n_turns, by[c].turns_sha256, by[c].loss_chars, by[c].loss_sha256) == (n, digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_tokens_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(3)
    bits = ["the", " ", "\n", "Été", "é́", " ", "<|endoftext|>", "'s", "12", "!?", "ß", " ", "\x1c", "a" * 50, "İ"]
    texts = ["".join(r.choices(bits, k=30)) for _ in range(300)]
    m = tokens.Transducer.load(path)
    for t in texts:
        n = len(whole.encode(t, add_special_tokens=False))
        assert m.count(t.encode()) == n
        assert m.count(t.encode(), chunk=7) == n
    by = {x.doc_id: x for x in tokens.token_counts(docs(spark, DOCS), path).collect()}
    for i, t in DOCS:
        n = len(whole.encode(t or "", add_special_tokens=False))
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert tokens.token_counts(docs(spark, []), path).count() == 0
