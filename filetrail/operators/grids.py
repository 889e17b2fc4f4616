"""Statistics of row-major number grids held in an array column.

Everything here is an expression on one row: no grid is exploded and nothing is shuffled. Decoded images are too
large for boxed arrays; `operators.images` computes the same statistics on their bytes in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filetrail.functions.binary import let
from filetrail.functions.fingerprints import array_mean

# Block side of the flatness test, reach of the shift search, short side kept when thinning.
BLOCK = 8
SEARCH = 3
THIN_SIDE = 256


def _steps(count: int) -> Column:
    return F.sequence(F.lit(0), F.lit(count - 1))


def population_std(values: Column) -> Column:
    return let(
        values,
        lambda vs: let(
            array_mean(vs), lambda m: F.sqrt(array_mean(F.transform(vs, lambda v: (v - m) * (v - m))))
        ),
    )


def min_block_std(grid: Column, rows: int, cols: int, block: int = BLOCK) -> Column:
    """Smallest population deviation over whole blocks; of the whole grid if no block fits."""
    down, across = rows // block, cols // block
    if not down or not across:
        return population_std(grid)
    return F.array_min(
        F.transform(
            _steps(down * across),
            lambda k: population_std(
                F.flatten(
                    F.transform(
                        _steps(block),
                        lambda dy: F.slice(
                            grid,
                            ((F.floor(k / across) * block + dy) * cols + (k % across) * block + 1).cast("int"),
                            F.lit(block),
                        ),
                    )
                )
            ),
        )
    )


def _clamped(value: Column, top: int) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(top))


def median_residual(grid: Column, rows: int, cols: int, radius: int = 1) -> Column:
    """Mean absolute difference to the median of the surrounding square; edges are repeated."""
    side = 2 * radius + 1
    middle = side * side // 2

    def around(k: Column) -> Column:
        y, x = F.floor(k / cols), k % cols
        return F.transform(
            _steps(side * side),
            lambda j: F.get(
                grid,
                (_clamped(y + F.floor(j / side) - radius, rows - 1) * cols
                 + _clamped(x + j % side - radius, cols - 1)).cast("int"),
            ),
        )

    return array_mean(
        F.transform(
            _steps(rows * cols),
            lambda k: F.abs(F.get(grid, k) - F.get(F.array_sort(around(k)), F.lit(middle))),
        )
    )


def _difference(grid: Column, here: Column, along: Column, last: int, stride: int) -> Column:
    """Central difference along one axis, one-sided at its ends; zero for an axis of one cell."""
    if last == 0:
        return F.lit(0.0)
    ahead = F.get(grid, F.when(along < last, here + stride).otherwise(here))
    behind = F.get(grid, F.when(along > 0, here - stride).otherwise(here))
    inner = (along > 0) & (along < last)
    return (ahead - behind) / F.when(inner, 2.0).otherwise(1.0)


def edge_magnitude(grid: Column, rows: int, cols: int) -> Column:
    """array<double>: gradient length per cell."""
    return F.transform(
        _steps(rows * cols),
        lambda k: F.hypot(
            _difference(grid, k, k % cols, cols - 1, 1),
            _difference(grid, k, F.floor(k / cols).cast("int"), rows - 1, cols),
        ),
    )


def best_shift(moved: Column, fixed: Column, rows: int, cols: int, search: int = SEARCH) -> Column:
    """struct<dy, dx, distance>: the circular shift of `moved` that fits `fixed` best.

    Mean squared difference, compared to twelve decimals; the first of equals in dy-then-dx order wins.
    """
    reach = F.sequence(F.lit(-search), F.lit(search))

    def rolled(items: Column, by: Column, size: int) -> Column:
        cut = F.pmod(by, F.lit(size))
        return F.concat(F.slice(items, F.lit(size + 1) - cut, cut), F.slice(items, F.lit(1), F.lit(size) - cut))

    def error(lines: Column) -> Column:
        squares = F.zip_with(F.flatten(lines), fixed, lambda x, y: (x - y) * (x - y))
        return F.round(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / (rows * cols), 12)

    def trial(lines: Column, dy: Column, dx: Column) -> Column:
        return F.struct(error(rolled(lines, dy, rows)).alias("error"), dy.alias("dy"), dx.alias("dx"))

    lines = F.transform(_steps(rows), lambda y: F.slice(moved, y * cols + 1, F.lit(cols)))
    trials = let(
        lines,
        lambda ls: F.flatten(
            F.transform(
                reach,
                lambda dx: let(
                    F.transform(ls, lambda line: rolled(line, dx, cols)),
                    lambda turned: F.transform(reach, lambda dy: trial(turned, dy, dx)),
                ),
            )
        ),
    )
    return let(
        F.array_min(trials),
        lambda t: F.struct(
            t["dy"].alias("dy"), t["dx"].alias("dx"),
            F.hypot(t["dy"].cast("double"), t["dx"].cast("double")).alias("distance"),
        ),
    )


def thinned(grid: Column, rows: int, cols: int) -> tuple[Column, int, int]:
    """Every step-th row and column, with step = max(1, short side div 256); also the new size."""
    step = max(1, min(rows, cols) // THIN_SIDE)
    kept_rows, kept_cols = -(-rows // step), -(-cols // step)
    if step == 1:
        return grid, rows, cols
    kept = F.transform(
        _steps(kept_rows * kept_cols),
        lambda k: F.get(grid, (F.floor(k / kept_cols) * step * cols + (k % kept_cols) * step).cast("int")),
    )
    return kept, kept_rows, kept_cols


def channel_misalignment(red: Column, green: Column, blue: Column, rows: int, cols: int) -> Column:
    """Mean length of the shifts that align the red and blue edges with the green ones."""
    r, h, w = thinned(red, rows, cols)
    g, _, _ = thinned(green, rows, cols)
    b, _, _ = thinned(blue, rows, cols)
    return let(
        edge_magnitude(g, h, w),
        lambda target: F.round(
            (
                let(edge_magnitude(r, h, w), lambda e: best_shift(e, target, h, w)["distance"])
                + let(edge_magnitude(b, h, w), lambda e: best_shift(e, target, h, w)["distance"])
            ) / 2,
            4,
        ),
    )
