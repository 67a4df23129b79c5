"""Saved models of other tools: bytes written by hand here, read by a task, and the encoder's results."""

import struct

import numpy as np
import pytest

from voicegrid import config
from voicegrid.operators.encoders import Attention, Lstm
from voicegrid.plans import jobs
from voicegrid.sources import models, msgpack


def packed(x):
    if isinstance(x, dict):
        head = bytes([0x80 | len(x)]) if len(x) < 16 else b"\xde" + struct.pack(">H", len(x))
        return head + b"".join(packed(k) + packed(v) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return bytes([0x90 | len(x)]) + b"".join(map(packed, x))
    if isinstance(x, str):
        raw = x.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xd9" + bytes([len(raw)])) + raw
    if isinstance(x, bytes):
        return b"\xc6" + struct.pack(">I", len(x)) + x
    if isinstance(x, int):
        return bytes([x]) if x < 128 else b"\xcd" + struct.pack(">H", x)
    inner = packed((list(x.shape), str(x.dtype), x.tobytes()))
    return b"\xc9" + struct.pack(">I", len(inner)) + b"\x01" + inner


def lstm_file(p, layers, hidden):
    tree = {}
    for k in reversed(range(layers)):  # order in the file doesn't count, and 10 comes after 9
        cell = {}
        for n, g in enumerate("ifgo"):
            part = slice(n * hidden, (n + 1) * hidden)
            cell[f"i{g}"] = {"kernel": p[f"{k}.x"][:, part].astype(np.float32)}
            cell[f"h{g}"] = {"kernel": p[f"{k}.h"][:, part].astype(np.float32), "bias": p[f"{k}.b"][part].astype(np.float32)}
        tree[f"layers_{k}"] = {"cell": cell}
    return packed({"params": tree})


def attention_file(p, layers, dim, heads):
    tree = {"pooling": {"kernel": p["pool.w"], "bias": p["pool.b"]}, "first": {"kernel": p["in.w"], "bias": p["in.b"]}}
    for k in range(layers):
        layer = {n: {"kernel": p[f"{k}.{s}.w"].reshape(dim, heads, -1), "bias": p[f"{k}.{s}.b"].reshape(heads, -1)} for s, n in (("q", "query"), ("k", "key"), ("v", "value"))}
        tree[f"layers_{k}"] = layer | {"out": {"kernel": p[f"{k}.o.w"].reshape(heads, -1, dim), "bias": p[f"{k}.o.b"]}}
    return packed({"params": tree})


def drawn(encoder, n_features):
    rng = np.random.default_rng(3)
    return {k: rng.standard_normal(v.shape).astype(np.float32).astype(float) for k, v in encoder.init(n_features).items()}


@pytest.mark.parametrize("layers", [1, 12])
def test_lstm(spark, tmp_path, layers):
    p = drawn(Lstm(4, layers), 6)
    path = tmp_path / "model.msgpack"
    path.write_bytes(lstm_file(p, layers, 4))
    cfg = config.Config(model=config.Model(n_mfcc=6, lstm=config.LstmConfig(4, layers)))
    encoder, found = jobs.speaker_encoder(spark, cfg, str(path))
    assert found.keys() == p.keys() and all((found[k] == p[k]).all() for k in p)
    x = np.random.default_rng(0).standard_normal((2, 7, 6))
    assert np.allclose(encoder.embed(found, x), Lstm(4, layers).embed(p, x))
    with pytest.raises(ValueError, match="another encoder"):
        jobs.speaker_encoder(spark, config.Config(model=config.Model(n_mfcc=7, lstm=config.LstmConfig(4, layers))), str(path))


def test_attention(spark, tmp_path):
    p = drawn(Attention(8, 2, 4), 6)
    path = str(tmp_path / "model.msgpack")
    (tmp_path / "model.msgpack").write_bytes(attention_file(p, 2, 8, 4))
    found = models.load(spark, path)
    assert found.keys() == p.keys() and all((found[k] == p[k]).all() for k in p)
    # Imported once, the table is what is read.
    models.save(spark, path, {"in.w": np.ones((1, 1))})
    assert list(models.load(spark, path)) == ["in.w"]


@pytest.mark.parametrize("content", [b"", b"\xc1", packed({"a": {"b": 1}}), packed({"params": {"d": {"kernel": np.ones((2, 2))}}}), lstm_file(drawn(Lstm(2, 1), 2), 1, 2)[:-3]])
def test_what_is_no_model(content):
    with pytest.raises(ValueError):
        msgpack.parameters(content)


def test_numbers_and_constants():
    values = {b"\xff": -1, b"\xcb" + struct.pack(">d", 1.5): 1.5, b"\xd1" + struct.pack(">h", -300): -300, b"\xc3": True, b"\xc0": None, b"\xd9\x02ab": "ab", b"\xdc\x00\x01\x05": [5]}
    for raw, value in values.items():
        assert msgpack._Reader(raw).value() == value


def test_missing_models_are_told(spark, tmp_path):
    for name in ("none.msgpack", "none"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            models.load(spark, str(tmp_path / name))
