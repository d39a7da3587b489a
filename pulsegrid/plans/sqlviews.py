"""SQL of the signal views of sources.signals, for the oracles."""

EVENTS = "ev AS (SELECT 'events' AS track, CAST(event_id % 2 AS INTEGER) AS channel, event_id // 2 AS frame, value / 150.0 - 1.0 AS x FROM events)"
EVENTS16 = f"{EVENTS}, ev16 AS (SELECT track, channel, frame, least(32767 / 32768, greatest(-1.0, round(x * 32768) / 32768)) AS x FROM ev)"
EVENTS_HALF = f"{EVENTS}, evs AS (SELECT track, channel, frame, CASE WHEN (frame // 400) % 5 < 2 THEN x / 2000 WHEN (frame // 400) % 5 = 2 THEN 0.0 ELSE x END AS x FROM ev)"
LINE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINE = f"ln AS (SELECT strftime(l_shipdate, '%Y-%m') AS track, 0 AS channel, row_number() OVER (PARTITION BY strftime(l_shipdate, '%Y-%m') ORDER BY {LINE_ORDER}) - 1 AS frame, l_extendedprice / 52500.0 - 1.0 AS x FROM lineitem)"
EMBED = "em AS (SELECT CAST(vec_id AS VARCHAR) AS track, vec_id AS t, 0 AS channel, CAST(i - 1 AS BIGINT) AS frame, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i))"
MARKERS = """mk AS (SELECT 'm' || event_id AS id, event_type AS kind, event_id * 10 AS start_frame,
    CASE WHEN user_id % 2 = 0 THEN event_id * 10 + user_id % 500 END AS end_frame, CAST(event_id % 2 AS INTEGER) AS channel,
    CAST(floor(value / 50) AS DOUBLE) AS severity, event_type || ' ' || user_id AS label, props AS data, event_id % 7 = 0 AS user_created FROM events)"""


def db(x: str) -> str:
    return f"(CASE WHEN {x} <= 0 THEN NULL ELSE 20 * log10({x}) END)"


def r6(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


def interpolation(up: int, down: int, taps: int, phases: int, attenuation: float, source: str) -> str:
    """CTEs ending in up_(track, channel, n, y): `source`(track, channel, frame, x) at up / down times its rate, by its own formula.

    The Kaiser-windowed sinc of each position between two frames is the mean of its two
    neighbouring table rows, each of sum 1; the signal is 0 outside.
    """
    beta = 0.1102 * (attenuation - 8.7)
    cutoff = min(1.0, up / down)
    i0 = lambda z: f"list_sum(list_transform(range(0, 60), lambda j: pow(({z}) / 2, 2 * j) / pow(gamma(j + 1), 2)))"
    return f"""fr_ AS (SELECT DISTINCT (i * {down}) % {up} AS r FROM range({up}) t(i)),
ph_ AS (SELECT r, side, least(floor(r * {phases}.0 / {up}), {phases - 1}) + side AS p, CASE WHEN side = 1 THEN r * {phases}.0 / {up} - least(floor(r * {phases}.0 / {up}), {phases - 1}) ELSE 1 - (r * {phases}.0 / {up} - least(floor(r * {phases}.0 / {up}), {phases - 1})) END AS share FROM fr_, range(2) s(side)),
tp_ AS (SELECT r, side, share, k, k - {taps // 2 - 1} - p / {phases}.0 AS x FROM ph_, range({taps}) t(k)),
tw_ AS (SELECT *, (CASE WHEN x = 0 THEN 1 ELSE sin(pi() * {cutoff} * x) / (pi() * {cutoff} * x) END) * {i0(f"{beta} * sqrt(greatest(0, 1 - pow(2 * x / {taps}, 2)))")} AS h FROM tp_),
tn_ AS (SELECT r, k, sum(share * h / s) AS h FROM (SELECT *, sum(h) OVER (PARTITION BY r, side) AS s FROM tw_) GROUP BY r, k),
ln_ AS (SELECT track, channel, max(frame) + 1 AS n FROM {source} GROUP BY ALL),
ot_ AS (SELECT track, channel, i AS n, (i * {down}) // {up} AS base, (i * {down}) % {up} AS r FROM ln_, LATERAL (SELECT unnest(range((ln_.n * {up}) // {down})) AS i)),
up_ AS (SELECT o.track, o.channel, o.n, sum(coalesce(s.x, 0) * h) AS y FROM ot_ o JOIN tn_ USING (r) LEFT JOIN {source} s ON s.track = o.track AND s.channel = o.channel AND s.frame = o.base + k - {taps // 2 - 1} GROUP BY ALL)"""


def k_weighted(first: tuple, second: tuple, source: str) -> str:
    """A recursive CTE kw_(track, channel, frame, y, s1..s4): two second-order sections over `source`, sample after sample."""
    (b0, b1, b2), (_, a1, a2) = first
    (c0, c1, c2), (_, d1, d2) = second
    y1 = f"({b0!r} * x + s1)"
    y = f"({c0!r} * {y1} + s3)"
    step = f"{y} AS y, {b1!r} * x - {a1!r} * {y1} + s2 AS s1, {b2!r} * x - {a2!r} * {y1} AS s2, {c1!r} * {y1} - {d1!r} * {y} + s4 AS s3, {c2!r} * {y1} - {d2!r} * {y} AS s4"
    return f"""kw_ AS (SELECT track, channel, frame, {step} FROM (SELECT *, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3, 0.0::DOUBLE AS s4 FROM {source} WHERE frame = 0)
UNION ALL SELECT track, channel, frame, {step} FROM (SELECT s.track, s.channel, s.frame, s.x, s1, s2, s3, s4 FROM kw_ JOIN {source} s ON s.track = kw_.track AND s.channel = kw_.channel AND s.frame = kw_.frame + 1))"""
