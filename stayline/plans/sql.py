"""SQL fragments of the bindings, for the second engine."""

from __future__ import annotations

from stayline.plans.bindings import EVENT_TYPES, ONSET_ERRORS
from stayline.spec import CONFIG

SITE = "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END"
UNIT1 = "CASE WHEN user_id % 5 <> 0 THEN (user_id % 7) % 2 END"

_MAXES = ",\n".join(
    f"max(value) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES
)
_NAMES = ", ".join(f'h."{t}"' for t in EVENT_TYPES)
VARS = ", ".join(f'"{t}"' for t in EVENT_TYPES)

PANEL = f"""
WITH ev AS (
  SELECT *, {SITE} AS site, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS eh FROM events),
bounds AS (SELECT user_id, min(eh) AS h0, max(eh) AS h1 FROM ev GROUP BY user_id),
spine AS (SELECT user_id, h0, unnest(range(h0, h1 + 1)) AS eh FROM bounds),
hourly AS (
  SELECT user_id, eh, {_MAXES}, count(*) AS n_events,
         count(*) FILTER (WHERE event_type = 'error') AS n_errors
  FROM ev GROUP BY user_id, eh),
errors AS (
  SELECT user_id, eh, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM ev WHERE event_type = 'error'),
onset AS (SELECT user_id, eh AS onset_eh FROM errors WHERE rn = {ONSET_ERRORS}),
panel AS (
  SELECT {SITE.replace('user_id', 's.user_id')} AS site, s.user_id, s.eh,
         CAST(s.eh - s.h0 AS INTEGER) AS hour, CAST(s.eh - s.h0 + 1 AS INTEGER) AS clock, {_NAMES},
         coalesce(h.n_events, 0) AS n_events, coalesce(h.n_errors, 0) AS n_errors,
         CAST(CASE WHEN s.eh >= o.onset_eh THEN 1 ELSE 0 END AS INTEGER) AS label,
         CAST(20 + s.user_id % 75 AS INTEGER) AS age,
         CAST((s.user_id % 3) % 2 AS INTEGER) AS gender,
         CAST({UNIT1.replace('user_id', 's.user_id')} AS INTEGER) AS unit1,
         CAST(1 - {UNIT1.replace('user_id', 's.user_id')} AS INTEGER) AS unit2
  FROM spine s LEFT JOIN hourly h USING (user_id, eh) LEFT JOIN onset o USING (user_id))
"""

SCORED = PANEL + """,
counted AS (
  SELECT *, sum(n_errors) OVER (PARTITION BY user_id ORDER BY hour) AS ecum,
    sum(n_events) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n24,
    sum(n_events) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS n72
  FROM panel),
scores AS (
  SELECT *, CAST(2 * ecum + 3 * n24 + n72 AS DOUBLE) AS x, CAST(4 * ecum + n24 + n72 AS DOUBLE) AS xb FROM counted),
scored AS (
  SELECT *, x / (x + 30) AS score, xb / (xb + 40) AS score_b,
    (x / (x + 30) + xb / (xb + 40)) / 2 AS score_ab FROM scores)
"""


def splits(source: str = "ev") -> str:
    return f""",
ids AS (SELECT DISTINCT site, user_id FROM {source}),
seeded AS (
  SELECT site, user_id, count(*) OVER (PARTITION BY site) AS n,
    row_number() OVER (PARTITION BY site ORDER BY md5('{CONFIG.seed}:' || user_id), user_id) AS seed_rank
  FROM ids),
splits AS (
  SELECT site, user_id,
    CASE WHEN seed_rank <= least(greatest(CAST(round_even(0.8 * n, 0) AS BIGINT), 1), n - 1)
      THEN CASE site WHEN 'A' THEN 'a_train' ELSE 'b_train' END
      ELSE CASE site WHEN 'A' THEN 'a_val' ELSE 'b_eval' END END AS split
  FROM seeded)
"""


def utility(source: str, threshold: str, keys: str = "site, user_id", prefix: str = "") -> str:
    """Rows with onset and the utility of alerting, staying quiet, the choice, and the best one."""
    onsets, rel, uvals, util = (prefix + n for n in ("onsets", "rel", "uvals", "util"))
    return f""",
{onsets} AS (SELECT {keys}, min(CASE WHEN label = 1 THEN hour END) AS onset FROM {source} GROUP BY {keys}),
{rel} AS (SELECT s.*, onset, hour - onset - 6 AS dt, {threshold} AS t FROM {source} s JOIN {onsets} USING ({keys})),
{uvals} AS (
  SELECT *,
    CASE WHEN onset IS NULL THEN -0.05e0 WHEN dt <= -6 THEN greatest((dt + 12) / 6e0, -0.05e0)
         WHEN dt <= 3 THEN (3 - dt) / 9e0 ELSE 0e0 END AS u1,
    CASE WHEN onset IS NULL THEN 0e0 WHEN dt <= -6 THEN 0e0
         WHEN dt <= 3 THEN -2e0 * (dt + 6) / 9e0 ELSE 0e0 END AS u0
  FROM {rel}),
{util} AS (
  SELECT *, CASE WHEN score >= t THEN u1 ELSE u0 END AS u,
    CASE WHEN dt BETWEEN -12 AND 3 THEN u1 ELSE u0 END AS ubest FROM {uvals})
"""


def ranks(source: str, groups: str) -> str:
    """AUROC by mid-ranks and average precision by thresholds, per group."""
    return f""",
tied AS (SELECT {groups}, score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY {groups}, score),
cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY {groups} ORDER BY score DESC) AS tp,
    sum(n) OVER (PARTITION BY {groups} ORDER BY score DESC) AS k,
    sum(n) OVER (PARTITION BY {groups} ORDER BY score) - n + (n + 1) / 2e0 AS midrank FROM tied),
ranked AS (
  SELECT {groups}, sum(pos) AS p, sum(n) AS total,
    (sum(pos * midrank) - sum(pos) * (sum(pos) + 1) / 2e0) / nullif(CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0) AS auroc,
    CASE WHEN sum(pos) < sum(n) THEN sum(CAST(pos AS DOUBLE) * tp / k) / nullif(sum(pos), 0) END AS auprc
  FROM cum GROUP BY {groups})
"""


def num(x: float) -> str:
    """A double literal (plain decimals would be read as fixed point)."""
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def isotonic_sql(name: str, fit: str, keys: str = "") -> str:
    """`name` (keys, x, v): the isotonic fit of `fit` (keys, x, y) at its distinct x.

    By the definition: the largest, over all starts up to x, of the smallest mean
    over all ends from x on.
    """
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    lead = ", ".join(f"a.{k.strip()}" for k in keys.split(",")) + ", " if keys else ""
    return f""",
{name}_n AS (SELECT {by}x, row_number() OVER ({part}ORDER BY x) AS i, sum(sum(y)) OVER ({part}ORDER BY x) AS s, sum(count(*)) OVER ({part}ORDER BY x) AS w,
  sum(y) AS own_s, count(*) AS own_w FROM ({fit}) GROUP BY {by}x),
{name}_m AS (SELECT {lead}a.i AS j, b.i AS k, CAST(b.s - a.s + a.own_s AS DOUBLE) / (b.w - a.w + a.own_w) AS m FROM {name}_n a JOIN {name}_n b {using} WHERE a.i <= b.i),
{name}_l AS (SELECT {by}k AS i, min(m) OVER (PARTITION BY {by}j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM {name}_m),
{name} AS (SELECT {by}x, max(least) AS v FROM {name}_l JOIN {name}_n USING ({by}i) GROUP BY {by}x)"""


def calibrated_sql(name: str, rows: str, fit: str, keys: str = "") -> str:
    """`name`: `rows` (keys, score, ...) with the score on the line between the fitted values around it, clipped outside."""
    on = "".join(f"q.{k.strip()} = f.{k.strip()} AND " for k in keys.split(",")) if keys else ""
    return f""",
{name} AS (
  SELECT q.* EXCLUDE (score, x0, v0), coalesce(
    v0 + coalesce((q.score - x0) / CASE WHEN f.x > x0 THEN f.x - x0 END, 0e0) * (f.v - v0), v0, f.v) AS score
  FROM (SELECT q.*, f.x AS x0, f.v AS v0 FROM ({rows}) q ASOF LEFT JOIN {fit} f ON {on}q.score >= f.x) q
  ASOF LEFT JOIN {fit} f ON {on}q.score <= f.x)"""
