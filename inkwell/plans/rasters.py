"""Raster kernels over vectors seen as small grey pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkwell.functions import rasters as r
from inkwell.operators import regions
from inkwell.plans.base import query, sig, with_views

SIDE = 8
KERNELS = "sig_id long, otsu int, white double, parts int, tall int, n_staffs int, angle double, cleaned int, hog double, inked_patches int"


def picture(v) -> np.ndarray:
    """A vector of 64 as 8 by 8 greys, repeated to 32 by 32."""
    x = np.asarray(v, float)
    grey = np.clip(np.round((x - x.min()) / max(np.ptp(x), 1e-12) * 255), 0, 255).reshape(SIDE, SIDE)
    return np.kron(grey, np.ones((4, 4)))


def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, v in zip(batch["sig_id"], batch["v"], strict=True):
            g = picture(v)
            level = r.otsu(g)
            mask = g <= level
            angle = r.principal_axis(mask.astype(float))[0]
            found = r.staffs(mask)
            hog = float(np.linalg.norm(r.gradient_histograms(g, cell=8)))
            canvas = r.ink_canvas(g, 56, 2)
            rows.append((i, level, r.white_fraction(g, 200), int(r.labelled(mask).max()), int(r.longest_runs(mask).max()), len(found), round(angle, 6), int(r.cleaned(mask).sum()), round(hog, 6), int(r.ink_patches(canvas).sum())))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in KERNELS.split(", ")])


@query("c42_c58_raster_kernels")
def kernels(spark, d):
    return sig(spark, d).select("sig_id", "v").mapInPandas(measured, KERNELS)


@query("c48_c50_k5_ceiling_trials")
def ceiling(spark, d):
    """Each mark against a perturbed copy of itself, as same-writer ceilings are measured."""

    def trials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, v in zip(batch["sig_id"], batch["v"], strict=True):
                g = picture(v)
                a, b = (255 - g) / 255, (255 - r.perturbed(g, int(i))) / 255
                b = r.aligned(b, a)
                rows.append((i, round(r.masked_ssim(a, b, r.ink_union(a, b, 2)), 6), round(r.masked_ssim(a, b), 6)))
            yield pd.DataFrame(rows, columns=["sig_id", "ssim_masked", "ssim"])

    return sig(spark, d).select("sig_id", "v").mapInPandas(trials, "sig_id long, ssim_masked double, ssim double")


PAGE = 64
#: Ink of a mark's page: rows and leaning columns where its unit vector is high, with a gap every 45th place.
PIXELS = with_views("uni") + """, px AS (SELECT sig_id, y, x FROM uni, range(64) ty(y), range(64) tx(x)
  WHERE (u[y + 1] > 0.2 OR u[((x - y // 16 + 64) % 64) + 1] > 0.2) AND (x + y * 5 + sig_id) % 45 <> 0)"""


def page_of(i: int, v) -> np.ndarray:
    u = np.asarray(v, float)
    high = u / np.linalg.norm(u) > 0.2
    y, x = np.mgrid[:PAGE, :PAGE]
    return (high[y] | high[(x - y // 16) % PAGE]) & ((x + y * 5 + i) % 45 != 0)


def by_page(spark, d, schema: str, measure):
    """One row for each mark: ``measure`` of its page."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *measure(page_of(i, v))) for i, v in zip(batch["sig_id"], batch["v"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return sig(spark, d).select("sig_id", "v").mapInPandas(step, schema)


@query("c52_g6_rule_strip", PIXELS + """, r AS (SELECT *, x - row_number() OVER (PARTITION BY sig_id, y ORDER BY x) AS g FROM px),
n AS (SELECT *, count(*) OVER (PARTITION BY sig_id, y, g) AS run FROM r), l AS (SELECT sig_id, y, count(*) AS px FROM n WHERE run >= 30 GROUP BY sig_id, y),
b AS (SELECT *, y - row_number() OVER (PARTITION BY sig_id ORDER BY y) AS band FROM l), k AS (SELECT *, count(*) OVER (PARTITION BY sig_id, band) AS rows_ FROM b),
s AS (SELECT sig_id, sum(px)::BIGINT AS rule_px FROM k WHERE rows_ <= 4 GROUP BY sig_id), a AS (SELECT sig_id, count(*) AS ink FROM px GROUP BY sig_id)
SELECT uni.sig_id, coalesce(ink, 0) AS ink, coalesce(rule_px, 0) AS rule_px FROM uni LEFT JOIN a ON uni.sig_id = a.sig_id LEFT JOIN s ON uni.sig_id = s.sig_id""")
def rule_strip(spark, d):
    return by_page(spark, d, "sig_id long, ink long, rule_px long", lambda m: (int(m.sum()), int((m & ~r.without_rules(m)).sum())))


@query("c53_c54_tall_strokes", PIXELS + """, w AS (SELECT DISTINCT sig_id, y, x + o AS x FROM px, range(-3, 4) t(o) WHERE x + o BETWEEN 0 AND 63),
g AS (SELECT *, y - row_number() OVER (PARTITION BY sig_id, x ORDER BY y) AS g FROM w), n AS (SELECT *, count(*) OVER (PARTITION BY sig_id, x, g) AS run FROM g),
t AS (SELECT DISTINCT sig_id, y, x + o AS x FROM n, range(-3, 4) q(o) WHERE run >= 12), p AS (SELECT px.*, t.x IS NOT NULL AS tall FROM px LEFT JOIN t ON px.sig_id = t.sig_id AND px.y = t.y AND px.x = t.x),
c AS (SELECT sig_id, count_if(tall) AS tall_px, count_if(tall OR y < 32 OR x < 16) AS left_px FROM p GROUP BY sig_id)
SELECT uni.sig_id, coalesce(tall_px, 0) AS tall_px, coalesce(left_px, 0) AS left_px FROM uni LEFT JOIN c ON uni.sig_id = c.sig_id""")
def tall_strokes(spark, d):
    """Ink of tall strokes, and what is left when all else is erased from the right of the lower half."""
    area = [("vkeep", 0.25, 0.5, 1.0, 1.0)]
    return by_page(spark, d, "sig_id long, tall_px long, left_px long", lambda m: (int(r.tall_strokes(m).sum()), int(r.erased(m, np.where(m, 0, 255), area).sum())))


@query("c36_c57_g8_staffs", PIXELS + """, w AS (SELECT DISTINCT sig_id, y, x + o AS x FROM px, range(-1, 2) t(o) WHERE x + o BETWEEN 0 AND 63),
g AS (SELECT *, y - row_number() OVER (PARTITION BY sig_id, x ORDER BY y) AS g FROM w), n AS (SELECT sig_id, x, g, count(*) AS run FROM g GROUP BY sig_id, x, g),
c AS (SELECT sig_id, x, max(run) AS run FROM n GROUP BY sig_id, x HAVING max(run) >= 0.45 * 64), i AS (SELECT *, x - row_number() OVER (PARTITION BY sig_id ORDER BY x) AS k FROM c),
s AS (SELECT sig_id, (min(x) + max(x)) / 2 AS cx FROM i GROUP BY sig_id, k), d AS (SELECT *, cx - lag(cx) OVER (PARTITION BY sig_id ORDER BY cx) AS gap FROM s),
f AS (SELECT sig_id, count(*) AS n_staffs, coalesce(count_if(round(gap / 64, 2) <= 0.35), 0) AS n_close, max(gap) AS widest FROM d GROUP BY sig_id)
SELECT uni.sig_id, coalesce(n_staffs, 0) AS n_staffs, coalesce(n_close, 0) AS n_close, coalesce(widest, 0) AS widest FROM uni LEFT JOIN f ON uni.sig_id = f.sig_id""")
def staffs(spark, d):
    """Staffs, how many neighbours are close, and the widest distance between the centres of neighbours."""

    def measure(m: np.ndarray) -> tuple:
        found = r.staffs(m)
        widest = max(((c + d - a - b) / 2 for (a, b), (c, d) in zip(found, found[1:], strict=False)), default=0.0)
        return len(found), r.staff_gaps(found, PAGE)[1], widest

    return by_page(spark, d, "sig_id long, n_staffs long, n_close long, widest double", measure)


@query("c35_c47_c51_c58_page_measures", PIXELS + """, m AS (SELECT sig_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cov, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px GROUP BY sig_id),
p AS (SELECT sig_id, count(*) AS patches FROM (SELECT sig_id, y // 16 AS py, x // 16 AS px, count(*) AS n FROM px GROUP BY 1, 2, 3) q WHERE n / 256 > 0.08 GROUP BY sig_id)
SELECT uni.sig_id, coalesce(patches, 0) AS inked_patches, 1 - coalesce(n, 0) / 4096 AS white, round(CASE WHEN n > 1 THEN degrees(0.5 * atan2(2 * cov, vx - vy)) ELSE 0 END, 4) AS angle,
round(CASE WHEN n > 1 THEN cx ELSE 32 END, 4) AS cx, round(CASE WHEN n > 1 THEN cy ELSE 32 END, 4) AS cy, round(coalesce(w / h, 0), 6) AS aspect FROM uni LEFT JOIN m ON uni.sig_id = m.sig_id LEFT JOIN p ON uni.sig_id = p.sig_id""")
def page_measures(spark, d):
    """Inked patches, white share, principal axis with its centre, and the aspect of the ink's box."""

    def measure(m: np.ndarray) -> tuple:
        angle, cx, cy = r.principal_axis(m.astype(float))
        return int(r.ink_patches(m.astype(float), 16).sum()), r.white_fraction(np.where(m, 0, 255)), round(angle, 4), round(cx, 4), round(cy, 4), round(r.ink_aspect(m), 6)

    return by_page(spark, d, "sig_id long, inked_patches long, white double, angle double, cx double, cy double, aspect double", measure)


#: The pages of a document below each other, with an empty row between them.
TALL = PAGE + 1


@query("c55_c56_parts_by_tiles", PIXELS + """ SELECT uni.pdf, count(px.x) AS ink, true AS whole FROM uni LEFT JOIN px ON uni.sig_id = px.sig_id GROUP BY uni.pdf""")
def parts_by_tiles(spark, d):
    """Ink of each document as its connected parts have it, of one tall picture in tiles of 256; ``whole``: as many parts, of the same sizes, as its pages labelled at once have."""

    def dark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, i % 50 * TALL, *np.nonzero(page_of(i, v))) for i, p, v in zip(batch["sig_id"], batch["pdf"], batch["v"], strict=True)]
            yield pd.DataFrame({"pdf": np.repeat([f[0] for f in found], [len(f[2]) for f in found]), "y": np.concatenate([f[1] + f[2] for f in found]), "x": np.concatenate([f[3] for f in found])})

    s = sig(spark, d).select("sig_id", "pdf", "v")
    parts = regions.connected_parts(s.mapInPandas(dark, "pdf long, y long, x long"), ["pdf"], 256)
    sizes = parts.groupBy("pdf").agg(F.sum("n").alias("ink"), F.count("*").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))

    def at_once(m: np.ndarray) -> tuple:
        n = np.bincount(r.labelled(m).ravel())[1:]
        return len(n), int((n * n).sum())

    pages = by_page(spark, d, "sig_id long, n long, squares long", at_once).join(s.select("sig_id", "pdf"), "sig_id")
    wanted = pages.groupBy("pdf").agg(F.sum("n").alias("want_n"), F.sum("squares").alias("want_squares"))
    whole = (F.coalesce("n", F.lit(0)) == F.col("want_n")) & (F.coalesce("squares", F.lit(0)) == F.col("want_squares"))
    return wanted.join(sizes, "pdf", "left").select("pdf", F.coalesce("ink", F.lit(0)).alias("ink"), whole.alias("whole"))
