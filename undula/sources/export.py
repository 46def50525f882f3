"""Recordings as training examples and as pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.core import windows


def examples(channels: DataFrame, win: int, hop: int | None = None, labels: DataFrame | None = None, layout: str = "NCT") -> DataFrame:
    """rec, w, label and x of every full window of recordings with channels (rec, channel, idx, value): 32-bit numbers, a list
    for each channel in the order of their names (`NCT`) or for each instant (`NTC`).

    `labels` (rec, label) are repeated for each window. A recording with fewer channels than the others, or a window with a gap
    or with fewer samples of one channel, gives none.
    """
    if layout not in ("NCT", "NTC"):
        raise ValueError("layout has to be NCT or NTC")
    key = F.to_json(F.struct("rec", "channel"))
    kinds = ", ".join(f"{c} {channels.schema[c].dataType.simpleString()}" for c in ("rec", "channel"))
    cut = windows(channels.select(key.alias("rec"), "idx", "value"), win, hop)
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("float").alias("value"))))
    each = cut.groupBy("rec", "w").agg(F.transform(pairs, lambda p: p["value"]).alias("x")).where((F.size("x") == win) & F.forall("x", lambda v: v.isNotNull()))
    each = each.withColumn("key", F.from_json("rec", kinds)).select("key.rec", "key.channel", "w", "x")
    most = channels.groupBy("rec").agg(F.count_distinct("channel").alias("n")).agg(F.max("n")).first()[0] or 0
    sides = F.array_sort(F.collect_list(F.struct("channel", "x")))
    whole = each.groupBy("rec", "w").agg(F.transform(sides, lambda s: s["x"]).alias("x")).where(F.size("x") == most)
    if layout == "NTC":
        instant = lambda t: F.transform("x", lambda c: F.get(c, t))
        whole = whole.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(win - 1)), instant))
    if labels is None:
        return whole.withColumn("label", F.lit(None).cast("string")).select("rec", "w", "label", "x")
    return whole.join(labels.select("rec", "label"), "rec", "left").select("rec", "w", "label", "x")


def epoch_examples(cut: DataFrame) -> DataFrame:
    """rec, event, label and x, the 32-bit values in order, of epochs() of one channel."""
    pairs = F.array_sort(F.collect_list(F.struct("rel", F.col("value").cast("float").alias("value"))))
    return cut.groupBy("rec", "event", "label").agg(F.transform(pairs, lambda p: p["value"]).alias("x"))


def thinned(samples: DataFrame, points: int = 600) -> DataFrame:
    """rec, bucket, first, low, high and mean of so many equal stretches of each recording: as much as a picture can show."""
    n = samples.groupBy("rec").agg((F.max("idx") + 1).alias("n"))
    bucket = F.floor(F.col("idx") * points / F.greatest("n", F.lit(points)))
    return samples.join(n, "rec").groupBy("rec", bucket.alias("bucket")).agg(F.min("idx").alias("first"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def _scaled(values: list[float | None], low: float, high: float, size: float) -> list[float | None]:
    return [None if v is None else (v - low) / ((high - low) or 1.0) * size for v in values]


def svg(lines: dict[str, tuple[list[float], list[float | None]]], title: str = "", width: int = 640, height: int = 200, marks: list[float] | None = None) -> str:
    """Lines (x, y) over common axes, a gap where y is None, and upright marks."""
    xs = [x for a, _ in lines.values() for x in a] + list(marks or [])
    ys = [y for _, b in lines.values() for y in b if y is not None]
    if not xs or not ys:
        return f'<svg width="{width}" height="{height}"><text x="8" y="20">{_text(title)}: nothing to show</text></svg>'
    box = min(xs), max(xs), min(ys), max(ys)
    parts = [f'<text x="8" y="16">{_text(title)}</text>', f'<text x="8" y="{height - 4}">{box[0]:.4g} to {box[1]:.4g}; {box[2]:.4g} to {box[3]:.4g}</text>']
    for nth, (name, (x, y)) in enumerate(lines.items()):
        at = zip(_scaled(x, box[0], box[1], width - 20), _scaled(y, box[2], box[3], height - 50), strict=True)
        runs, path = [], []
        for a, b in at:
            if b is None:
                runs, path = [*runs, path], []
            else:
                path = [*path, f"{10 + a:.1f},{height - 22 - b:.1f}"]
        for run in [*runs, path]:
            if run:
                parts.append(f'<polyline fill="none" stroke="{COLOURS[nth % len(COLOURS)]}" points="{" ".join(run)}"><title>{_text(name)}</title></polyline>')
    for m in _scaled(list(marks or []), box[0], box[1], width - 20):
        parts.append(f'<line x1="{10 + m:.1f}" x2="{10 + m:.1f}" y1="22" y2="{height - 22}" stroke="{COLOURS[-1]}"/>')
    return f'<svg width="{width}" height="{height}">{"".join(parts)}</svg>'


COLOURS = ["#1b6ca8", "#c8553d", "#3a7d44", "#7b5ea7", "#999999"]


def _text(x) -> str:
    return str(x).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def plot_signal(samples: DataFrame, rec, fs: float | None = None, marks: list[float] | None = None, title: str = "signal", points: int = 600) -> str:
    """One recording's extremes in so many stretches; `points` rows reach the driver."""
    rows = sorted(thinned(samples.where(F.col("rec") == rec), points).collect(), key=lambda r: r.bucket)
    x = [r.first / (fs or 1.0) for r in rows]
    return svg({"low": (x, [r.low for r in rows]), "high": (x, [r.high for r in rows])}, title, marks=marks)


def plot_curve(table: DataFrame, rec, x: str, y: str, title: str = "", points: int = 600) -> str:
    """Two columns of a result table (spectrum, psd, autocorrelation, timeline, forecast) of one recording; of more rows than
    `points` the mean of each stretch."""
    own = table.where(F.col("rec") == rec).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    span = own.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    wide = (span.b - span.a) if span.a is not None and span.b > span.a else 1.0
    bucket = F.floor((F.col("x") - F.lit(span.a or 0.0)) / wide * (points - 1))
    rows = sorted(own.groupBy(bucket.alias("k")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect(), key=lambda r: (r.x is None, r.x))
    rows = [r for r in rows if r.x is not None]
    return svg({y: ([r.x for r in rows], [r.y for r in rows])}, title or y)


def plot_heat(table: DataFrame, rec, x: str, y: str, value: str, title: str = "", columns: int = 120, rows: int = 64) -> str:
    """A time-frequency table (stft, wavelet) or a correlation matrix of numbers as cells of grey."""
    own = table.where(F.col("rec") == rec)
    span = own.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
    if span.a is None:
        return svg({}, title)
    place = lambda c, low, high, n: F.floor((F.col(c) - low) / ((high - low) or 1.0) * (n - 1)).cast("int")
    cells = own.groupBy(place(x, span.a, span.b, columns).alias("i"), place(y, span.c, span.d, rows).alias("j")).agg(F.avg(value).alias("v")).where("v IS NOT NULL").collect()
    most = max((abs(c.v) for c in cells), default=1.0) or 1.0
    boxes = "".join(f'<rect x="{10 + 5 * c.i}" y="{24 + 3 * (rows - 1 - c.j)}" width="5" height="3" fill="hsl(210 60% {95 - 75 * abs(c.v) / most:.0f}%)"/>' for c in cells)
    return f'<svg width="{20 + 5 * columns}" height="{30 + 3 * rows}"><text x="8" y="16">{_text(title)}</text>{boxes}</svg>'


def plot_histogram(samples: DataFrame, rec, bins: int = 50, title: str = "values") -> str:
    own = samples.where((F.col("rec") == rec) & F.col("value").isNotNull())
    span = own.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    if span.a is None:
        return svg({}, title)
    wide = (span.b - span.a) or 1.0
    counts = {r.k: r.n for r in own.groupBy(F.least(F.floor((F.col("value") - span.a) / wide * bins), F.lit(bins - 1)).alias("k")).agg(F.count("*").alias("n")).collect()}
    return svg({"count": ([span.a + (k + 0.5) * wide / bins for k in range(bins)], [float(counts.get(k, 0)) for k in range(bins)])}, title)


def plot_response(response: list[tuple[float, float, float]], title: str = "filter") -> str:
    """frequency_response() before a filter is used."""
    f = [r[0] for r in response]
    return svg({"magnitude": (f, [r[1] for r in response])}, title) + svg({"phase": (f, [r[2] for r in response])}, f"{title}: phase")


def table_html(rows: DataFrame, title: str = "", most: int = 200) -> str:
    """The first `most` rows of a small result as a table."""
    body = "".join("<tr>" + "".join(f"<td>{_text(f'{v:.6g}' if isinstance(v, float) else v)}</td>" for v in r) + "</tr>" for r in rows.limit(most).collect())
    head = "".join(f"<th>{_text(c)}</th>" for c in rows.columns)
    return f"<h2>{_text(title)}</h2><table><tr>{head}</tr>{body}</table>"


def report(samples: DataFrame, rec, fs: float | None = None, steps: list[str] | None = None) -> str:
    """One recording's page: quality and the repairs it calls for, pictures, statistics, features of the first 300 seconds, a
    timeline from 60 seconds on, and the steps so far. Pictures are in the page; nothing is fetched from elsewhere."""
    from undula.operators import features, quality, spectral, statistics
    from undula.operators.cleaning import fill

    own = samples.where(F.col("rec") == rec)
    n = own.count()
    found = quality.fixes(quality.diagnose(own, fs))
    whole = fill(own, "interpolate")
    parts = [f"<h1>{_text(rec)}</h1><p>{n} samples{f', {n / fs:.6g} s' if fs else ''}</p>", table_html(found.withColumn("fixes", F.to_json("fixes")), "Quality"), plot_signal(own, rec, fs)]
    parts += [plot_histogram(own, rec), table_html(statistics.describe(own), "Statistics")]
    if fs:
        psd = spectral.to_db(spectral.welch(whole, fs))
        parts += [plot_curve(psd, rec, "freq", "db", "psd in dB")]
        if n / fs >= 60:
            lines = quality.timeline(own, 10.0, None, fs)
            parts += [plot_curve(lines, rec, "t_start", "score", "score over time"), table_html(lines, "Timeline")]
    early = whole.where(F.col("idx") < int(300 * (fs or 1.0)))
    parts += [table_html(features.extract(early, fs, ("time", "freq", "peaks") if fs else ("time", "peaks")), "Features"), "<h2>Steps</h2><ol>" + "".join(f"<li>{_text(s)}</li>" for s in steps or []) + "</ol>"]
    return "<!doctype html><meta charset='utf-8'><style>body{font-family:sans-serif}td,th{padding:2px 8px;border:1px solid #ccc}</style>" + "".join(parts)
