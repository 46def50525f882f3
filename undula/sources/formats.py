"""What the bytes of EDF, BDF, WAV and WFDB files mean."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: Names of EDF's and BDF's annotation signals.
EDF_MARKS = ("EDF Annotations", "BDF Annotations")
#: Bits of a value by the code of its storage.
BITS = {"i2": 16, "i3": 24, "i4": 32, "b2": 16, "u1": 8, "f4": 32, "f8": 64, "w2": 16, "w3": 24, "w4": 32, "w1": 8, "212": 12}
#: Fixed values of the WFDB formats: how each is stored here, and the bits of a value.
WFDB_CODES = {16: ("w2", 16), 24: ("w3", 24), 32: ("w4", 32), 61: ("b2", 16), 80: ("w1", 8), 212: ("212", 12)}
#: The value by which each WFDB format says that there is none.
NONE = {"w2": -(1 << 15), "w3": -(1 << 23), "w4": -(1 << 31), "b2": -(1 << 15), "w1": -128, "212": -2048}


def int24(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)
    return np.pad(b, ((0, 0), (1, 0))).view("<i4").reshape(-1) >> 8


def plain(raw: bytes, code: str) -> np.ndarray:
    """The digital values of bytes, NaN where a WFDB format says that there is none."""
    if code in ("i3", "w3"):
        x = int24(raw).astype(float)
    elif code == "212":  # two values of twelve bits in three bytes; the middle one has the high bits of both
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        both = np.stack([b[:, 0] + 256 * (b[:, 1] % 16), b[:, 2] + 256 * (b[:, 1] // 16)], axis=1).reshape(-1)
        x = (both - 4096 * (both >= 2048)).astype(float)
    elif code == "w1":
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    else:
        kind = {"w2": "<i2", "w4": "<i4", "b2": ">i2", "u1": "u1"}.get(code) or f"<{code}"
        width = np.dtype(kind).itemsize
        x = np.frombuffer(raw[: len(raw) // width * width], kind).astype(float)
    return np.where(x == NONE[code], np.nan, x) if code in NONE else x


def digital(raw: bytes, code: str, values: int) -> np.ndarray:
    """Whole records of so many values."""
    x = plain(raw, code)
    return x[: len(x) // values * values].reshape(-1, values)


def part_of(raw: bytes, size: int, start: int, count: int, code: str) -> bytes:
    """The bytes of `count` values from the place `start` on, of every record of `size` bytes."""
    width = BITS[code] // 8
    return np.frombuffer(raw[: len(raw) // size * size], np.uint8).reshape(-1, size)[:, start * width : (start + count) * width].tobytes()


def edf_header(head: bytes, more: Callable[[int], bytes], length: int) -> dict:
    """What the header of an EDF, EDF+ or BDF file says: its records and, for each signal, name, unit, ranges and samples a
    record. `more` gives so many bytes behind the first 256."""
    whole = lambda a, b: head[a:b].decode("latin-1").strip()
    size, records, seconds, n = int(whole(184, 192)), int(whole(236, 244)), float(whole(244, 252)), int(whole(252, 256))
    if n <= 0 or size < 256 * (n + 1):
        raise ValueError("not an EDF file")
    rest, at, fields = more(256 * n), 0, {}
    # Fixed widths of the format's signal fields.
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("count", 8), ("reserved", 32)):
        fields[name] = [rest[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(n)]
        at += n * width
    wide = 3 if head[:1] == b"\xff" else 2
    counts = [int(c) for c in fields["count"]]
    if min(counts) < 0 or not sum(counts):
        raise ValueError("records without samples")
    there = max(0, length - size) // (sum(counts) * wide)
    if records > there:
        raise ValueError("the file ends before its records do")
    numbers = {k: [float(v) for v in fields[k]] for k in ("pmin", "pmax", "dmin", "dmax")}
    return {"size": size, "records": there if records < 0 else records, "seconds": seconds, "wide": wide, "labels": fields["label"], "units": fields["unit"], "counts": counts, **numbers}


def tal(raw: bytes) -> list[tuple[float, float, str]]:
    """Time-stamped annotation lists: (onset, duration, text), from onset, 0x15 and duration, and texts each ended by 0x14."""
    found = []
    for entry in filter(None, raw.split(b"\x00")):
        stamp, *texts = entry.split(b"\x14")
        onset, _, duration = stamp.partition(b"\x15")
        try:
            at, lasts = float(onset), float(duration or 0)
        except ValueError:
            continue
        found += [(at, lasts, t.decode("latin-1")) for t in texts if t.strip()]
    return found


def wav_header(read: Callable[[int, int], bytes], length: int) -> dict:
    """Where a RIFF file's frames stand and how its values are stored; `read` gives so many bytes from a place on."""
    if read(4, 0) != b"RIFF" or read(4, 8) != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind = 12, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(8, at))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(16, at + 8))
            if kind == 0xFFFE:
                kind = struct.unpack("<H", read(2, at + 32))[0]
        if name == b"data" and kind is not None:
            if not channels or not rate or bits % 8 or kind not in (1, 3):
                raise ValueError(f"a WAV file of {channels} channels and {bits} bits of kind {kind} can't be read")
            code = f"f{bits // 8}" if kind == 3 else "u1" if bits == 8 else f"i{bits // 8}"
            frame = channels * bits // 8
            gain = 1.0 if kind == 3 else 2.0 ** (1 - bits)
            return {"code": code, "offset": at + 8, "frame": frame, "frames": min(size, length - at - 8) // frame, "channels": channels, "rate": float(rate), "zero": 128.0 if code == "u1" else 0.0, "gain": gain}
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wfdb_header(text: str) -> dict:
    """A WFDB header's record line and signal lines, field by field.

    Record line: name, signals, rate (250 unless said; a counter's rate may follow behind a slash), samples. Signal lines: file;
    format, with samples a frame behind an x, skew behind a colon and the first byte behind a plus; gain (200), with the
    baseline in brackets and the unit (mV) behind a slash; resolution; zero, which is the baseline if none is said; three
    more; name. Records of several segments and signals of several samples a frame are errors.
    """
    lines = [line.split() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    name, count, *rest = lines[0]
    if "/" in name:
        raise ValueError("records of several segments can't be read")
    fs = float(rest[0].partition("/")[0].partition("(")[0]) if rest else 250.0
    if fs <= 0:
        raise ValueError("a rate above zero is needed")
    signals = []
    for nth, (file, stored, *more) in enumerate(lines[1 : int(count) + 1]):
        stored, _, first = stored.partition("+")
        stored, _, _ = stored.partition(":")
        kind, _, frame = stored.partition("x")
        if int(frame or 1) != 1:
            raise ValueError("signals of several samples a frame can't be read")
        scale, _, unit = (more[0] if more else "").partition("/")
        gain, _, baseline = scale.rstrip(")").partition("(")
        zero = int(more[2]) if len(more) > 2 else 0
        signals.append(dict(
            file=file, format=int(kind), offset=int(first or 0), gain=float(gain or 0) or 200.0, baseline=int(baseline) if baseline else zero, unit=unit or "mV", name=" ".join(more[6:]) or f"sig{nth}",
        ))
    if len(signals) < int(count):
        raise ValueError("fewer signal lines than signals")
    return {"fs": fs, "n": int(rest[1]) if len(rest) > 1 else None, "signals": signals}
