import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from loomgraph.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a  b ", "▁ a▁b", "\t\n\r", "😀🎉 x", "日本語テキスト", "\x00a", "<s></s><unk><0x0A>", "a" * 3000, "ab" * 300 + " " + "é" * 100, "ﬁ Å ½", "नमस्ते", "Ａｂｃ　㌔ é​ z", "ｶﾞ ㍿"]


@pytest.fixture(scope="module", params=["plain", "nmt_nfkc"])
def pair(request):
    blob = spm.read_model(PATH)
    if request.param != "plain":  # the library's own compiled character map
        normal = sentencepiece.SentencePieceNormalizer(rule_name=request.param, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        source, model = pb.ModelProto(), pb.ModelProto()
        source.ParseFromString(normal.serialized_model_proto())
        model.ParseFromString(blob)
        model.normalizer_spec.CopyFrom(source.normalizer_spec)
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = True
        blob = model.SerializeToString()
    return spm.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)


def test_same_ids(pair):
    model, library = pair
    dice = random.Random(5)
    texts = ODD + ["".join(dice.choice("ab é▁ 日\n😀ﬁ½Ａtheing") for _ in range(dice.randrange(120))) for _ in range(400)]
    assert [t for t in texts if model.encode(t)[0] != library.encode(t)] == []


def test_spans_hold_the_pieces():
    """As the library's spans; bytes of an unknown character have a byte each, where the library gives all to the last."""
    model, library = spm.Model(spm.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ODD:
        ids, start, end = model.encode(text)
        spans = list(zip(start.tolist(), end.tolist(), strict=True))
        theirs = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        one_byte = set(model.bytes.values())
        assert [s for s, i in zip(spans, ids, strict=True) if i not in one_byte] == [s for s, i in zip(theirs, ids, strict=True) if i not in one_byte]
        assert all(e - s == 1 for (s, e), i in zip(spans, ids, strict=True) if i in one_byte)
        assert sorted(spans) == spans and (not text or spans[-1][1] == len(text.encode()))


def test_query_columns(odd):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = spm.encode(odd, spm.read_model(PATH), spm.DIGESTS).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(got) == 8
    for r in got:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert spm.encode(odd.limit(0), spm.read_model(PATH)).count() == 0
    for r in spm.encode(odd, spm.read_model(PATH), ("n_tokens", "starts", "ends", "spans", "covered_bytes")).collect():
        assert spm.unpacked_spans(r["spans"]).tolist() == [list(x) for x in zip(r["starts"], r["ends"], strict=True)]
        assert r["covered_bytes"] == len(texts[r["doc_id"]].encode())


def test_many_texts_as_one_by_one(pair):
    model, library = pair
    if not model.plain:
        return
    dice = random.Random(7)
    texts = ODD + ["".join(dice.choice("ab é▁ 日\n😀ﬁ½Ａtheing") for _ in range(dice.randrange(120))) for _ in range(300)] + ["", "▁", " ▁ x", "x" * 200 + " " + "y" * 200]
    data = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(d) for d in data]))
    ids, starts, ends, bounds, digits, decoded = model.encode_many(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, t in enumerate(texts):
        one, a, b = model.encode(t)
        here = slice(bounds[k], bounds[k + 1])
        assert (ids[here].tolist(), starts[here].tolist(), ends[here].tolist()) == (one, list(a), list(b)), t
        assert (digits[k].as_py(), decoded[k].as_py()) == ("".join(f"{i}," for i in one).encode(), library.decode(one).encode() if one else b""), t


def test_runs_of_unknown_characters_are_one_piece():
    """Without byte pieces; as the library does."""
    proto = pb.ModelProto()
    proto.ParseFromString(spm.read_model(PATH))
    for p in proto.pieces:
        if p.type == p.BYTE:
            p.type = p.CONTROL
    proto.trainer_spec.byte_fallback = False
    blob = proto.SerializeToString()
    model, library = spm.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in ["a 🤖🤖 b", "🤖", "🤖🤖", "🤖 🤖🤖x🤖", "x"]:
        assert model.encode(text)[0] == library.encode(text)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        raw = text.encode()
        assert [raw[a:b].strip() for a, b in zip(*model.encode(text)[1:], strict=True)] == [raw[a:b].strip() for a, b in spans]


def test_units_end_where_no_piece_goes_on():
    """Words that differ only beyond such a place share their units, and a line's end is a unit of its own; all as the library has it."""
    model, library = spm.Model(spm.read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert model.plain
    dice = random.Random(11)
    texts = ["the\n" + "\n".join(f"the{x}the" for x in "éçßжя日本\x00😀�"), *ODD, *("".join(dice.choice("ab éç▁ 日\n😀�ﬁheingtion") for _ in range(dice.randrange(90))) for _ in range(600))]
    data = "".join(texts).encode()
    ids, starts, ends, bounds, told, decoded = model.encode_many(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for i, t in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        some, start, end = model.encode(t)
        assert ids[a:b].tolist() == some == library.encode(t) and told[i].as_py() == "".join(f"{x}," for x in some).encode()
        assert starts[a:b].tolist() == start.tolist() and ends[a:b].tolist() == end.tolist()
        assert decoded[i].as_py().decode() == library.decode(some)
    assert b"\n" in model.known[False] and not any(len(u) > 1 and b"\n" in u.strip() for u in model.known[False])


def test_broken_bytes_are_cut_as_what_stands_for_them():
    model = spm.Model(spm.read_model(PATH))
    dice = random.Random(3)
    texts = [bytes(dice.choice([0x61, 0x20, 0xC3, 0xA9, 0xE2, 0x96, 0x81, 0xF0, 0x9F, 0xFF, 0x80, 0x74, 0x68]) for _ in range(dice.randrange(60))) for _ in range(400)]
    ids, _, _, bounds, _, decoded = model.encode_many(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        whole = t.decode("utf-8", "replace")
        assert ids[bounds[i] : bounds[i + 1]].tolist() == model.processor.encode(whole)
