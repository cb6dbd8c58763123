"""Plain Python evaluation of range functions and aggregations, to hold the engine against."""

from __future__ import annotations

import math


def ignoring_nan(pick, values):
    known = [v for v in values if not math.isnan(v)]
    return pick(known) if known else math.nan


def variance(values):
    mean = sum(values) / len(values)
    return sum((v - mean) ** 2 for v in values) / len(values)


def extrapolated(samples, start, end, counter):
    """samples: (t, v) in order, inside (start, end]."""
    if len(samples) < 2:
        return None
    (t0, v0), (t1, v1) = samples[0], samples[-1]
    rise = v1 - v0
    if counter:
        rise += sum(a for (_, a), (_, b) in zip(samples, samples[1:], strict=False) if b < a)
    span, gap = (t1 - t0) / 1000, (t1 - t0) / 1000 / (len(samples) - 1)
    head, tail = (t0 - start) / 1000, (end - t1) / 1000
    if counter and rise > 0 and v0 >= 0:
        head = min(head, span * (v0 / rise))
    reach = span + (head if head < 1.1 * gap else gap / 2) + (tail if tail < 1.1 * gap else gap / 2)
    return rise * (reach / span)


def over_time(name, samples, start, end):
    """The value of a range function over the samples of (start, end], or None."""
    inside = [(t, v) for t, v in samples if start < t <= end]
    values = [v for _, v in inside]
    if not inside:
        return None
    if name in ("rate", "increase", "delta"):
        x = extrapolated(inside, start, end, name != "delta")
        x = x / ((end - start) / 1000) if x is not None and name == "rate" else x
        return None if x is None or math.isnan(x) else x
    if name == "irate":
        if len(inside) < 2:
            return None
        (t0, v0), (t1, v1) = inside[-2:]
        x = (v1 if v1 < v0 else v1 - v0) / ((t1 - t0) / 1000)
        return None if math.isnan(x) else x
    return {
        "max_over_time": lambda: ignoring_nan(max, values), "min_over_time": lambda: ignoring_nan(min, values), "sum_over_time": lambda: sum(values), "avg_over_time": lambda: sum(values) / len(values),
        "count_over_time": lambda: float(len(values)), "present_over_time": lambda: 1.0, "last_over_time": lambda: values[-1], "stddev_over_time": lambda: math.sqrt(variance(values)), "stdvar_over_time": lambda: variance(values),
    }[name]()


def quantile(phi, values):
    if phi < 0:
        return -math.inf
    if phi > 1:
        return math.inf
    ordered = sorted(values)
    rank = phi * (len(ordered) - 1)
    lo = math.floor(rank)
    hi = min(lo + 1, len(ordered) - 1)
    return ordered[lo] + (ordered[hi] - ordered[lo]) * (rank - lo)


def histogram_quantile(phi, buckets):
    """buckets: (upper bound, cumulative count)."""
    buckets = sorted(buckets)
    if len(buckets) < 2 or buckets[-1][0] != math.inf:
        return None
    if phi < 0:
        return -math.inf
    if phi > 1:
        return math.inf
    most, counts = -math.inf, []
    for _, c in buckets:
        most = max(most, c)
        counts.append(most)
    if counts[-1] == 0:
        return math.nan
    rank = phi * counts[-1]
    i = next(k for k, c in enumerate(counts) if c >= rank or k == len(counts) - 1)
    if i == len(counts) - 1:
        return buckets[-2][0]
    upper = buckets[i][0]
    if i == 0 and upper <= 0:
        return upper
    lower, below = (buckets[i - 1][0], counts[i - 1]) if i else (0.0, 0.0)
    if counts[i] == below:
        return math.nan
    return lower + (upper - lower) * ((rank - below) / (counts[i] - below))


def judge(arrivals, window, min_valid=None):
    """Verdicts of (series, t) arrivals, one after another."""
    newest, seen, out = {}, set(), []
    for sid, t in arrivals:
        top = newest.get(sid)
        if min_valid is not None and t < min_valid:
            out.append("too_old")
        elif top is None or t > top:
            out.append("ok")
        elif t == top:
            out.append("duplicate")
        elif t < top - window:
            out.append("too_old")
        else:
            out.append("duplicate" if (sid, t) in seen else "late")
        if out[-1] in ("ok", "late"):
            seen.add((sid, t))
            newest[sid] = t if top is None else max(top, t)
    return out
