"""WAV files of tones."""

import io
import wave

import numpy as np


def synthetic_tones(spark, n, seconds=1.0):
    """(utt, content): WAV files of tones, for the tests."""
    rows = []
    for k in range(n):
        t = np.arange(int(16_000 * seconds)) / 16_000
        x = (8000 * np.sin(2 * np.pi * (200 + 50 * k) * t)).astype("<i2")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes(x.tobytes())
        rows.append((f"tone{k}", bytearray(out.getvalue())))
    return spark.createDataFrame(rows, "utt string, content binary")
