"""Sequential folds: state per key carried over rows in order."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import gridlore

# Functions of this package travel to the executors by value.
cloudpickle.register_pickle_by_value(gridlore)


def keyed_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[tuple], object], step: Callable[[object, pd.DataFrame], list], schema: str, end: Callable[[object], list] = lambda state: []) -> DataFrame:
    """Rows of each key in order through `step`, which changes the state and returns rows of output; `end` returns a key's last ones.

    Rows are sorted by Spark and streamed: a task holds one key's state and a
    batch of rows, never a whole key. Keys (leagues, configurations) run beside
    each other; a key's own rows have to be one after another.
    """
    names = [p.split()[0] for p in schema.split(",")]

    def run(batches):
        now, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            mark = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
            cuts = [i for i in range(len(pdf)) if i == 0 or mark[i] != mark[i - 1]] + [len(pdf)]
            out: list = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if mark[a] != now:
                    out += end(state) if state is not None else []
                    now, state = mark[a], start(mark[a])
                out += step(state, pdf.iloc[a:b])
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(end(state), columns=names)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@dataclass(frozen=True)
class Elo:
    """Settings of the rating replay.

    A margin counts by its logarithm, up to `cap`; a win of the favourite
    counts less, and with `absolute` an upset does too. A tie counts once.
    With `playoffs` False, games of type `post` are forecast but move nothing.
    """

    k: float = 20.0
    edge: float = 48.0
    regress: float = 0.33
    mean: float = 1500.0
    newcomer: float = 1500.0
    edge_step: float = 0.0
    scale: float = 400.0
    cap: float | None = None
    absolute: bool = False
    playoffs: bool = True
    post: str = "POST"
    edge_by_margin: bool = False


def margin_weight(margin, winner_edge, cfg: Elo):
    """What a margin counts, given the winner's rating lead with the home edge; 1 for a tie."""
    if margin == 0:
        return 1.0
    weight = math.log(abs(margin) + 1) * 2.2 / (0.001 * (abs(winner_edge) if cfg.absolute else winner_edge) + 2.2)
    return weight if cfg.cap is None else min(weight, cfg.cap)


class _EloState:
    def __init__(self, cfg: Elo) -> None:
        self.cfg, self.r, self.season, self.edge, self.first = cfg, {}, None, cfg.edge, True

    def play(self, season, home, away, hs, as_, neutral, kind=None):
        c = self.cfg
        if season != self.season:
            if self.season is not None:
                self.r = {t: v + c.regress * (c.mean - v) for t, v in self.r.items()}
                self.first = False
            self.season = season
        base = c.mean if self.first else c.newcomer
        h, a = self.r.get(home, base), self.r.get(away, base)
        diff = h + (0.0 if neutral else self.edge) - a
        p, before = 1 / (1 + 10 ** (-diff / c.scale)), self.edge
        if hs is None or as_ is None or hs != hs or as_ != as_ or (kind == c.post and not c.playoffs):
            return h, a, p, h, a, before
        y = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
        weight = margin_weight(hs - as_, diff if hs >= as_ else -diff, c)
        self.r[home], self.r[away] = h + c.k * weight * (y - p), a - c.k * weight * (y - p)
        if not neutral:
            self.edge += c.edge_step * (weight if c.edge_by_margin else 1.0) * (y - p)
        return h, a, p, self.r[home], self.r[away], before


class _EloGrid:
    """One replay of a league for all configurations at once: each rating is a vector over them."""

    def __init__(self, grid: list[Elo], window: tuple[int, int]) -> None:
        at = lambda f: np.array([f(c) for c in grid], float)
        self.k, self.edge, self.regress, self.mean = at(lambda c: c.k), at(lambda c: c.edge), at(lambda c: c.regress), at(lambda c: c.mean)
        self.newcomer, self.step, self.scale = at(lambda c: c.newcomer), at(lambda c: c.edge_step), at(lambda c: c.scale)
        self.cap, self.absolute = at(lambda c: np.inf if c.cap is None else c.cap), at(lambda c: c.absolute) > 0
        self.playoffs, self.by_margin, self.post = at(lambda c: c.playoffs), at(lambda c: c.edge_by_margin) > 0, grid[0].post
        self.slope, self.any_absolute = -math.log(10) / self.scale, bool(self.absolute.any())
        self.r, self.season, self.first, self.window = {}, None, True, window
        self.n, self.brier, self.logloss = 0, np.zeros(len(grid)), np.zeros(len(grid))

    def play(self, season, home, away, hs, as_, neutral, kind):
        if season != self.season:
            if self.season is not None:
                self.r = {t: v + self.regress * (self.mean - v) for t, v in self.r.items()}
                self.first = False
            self.season = season
        base = self.mean if self.first else self.newcomer
        h, a = self.r.get(home, base), self.r.get(away, base)
        diff = h - a if neutral else h + self.edge - a
        if hs is None or as_ is None or hs != hs or as_ != as_:
            return
        p = 1 / (1 + np.exp(diff * self.slope))
        y = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
        if self.window[0] <= season <= self.window[1]:
            q = np.clip(p, 1e-15, 1 - 1e-15)
            self.n += 1
            self.brier += (p - y) ** 2
            self.logloss -= np.log(q if y == 1 else 1 - q if y == 0 else q * (1 - q)) * (0.5 if y == 0.5 else 1.0)
        weight = 1.0
        if hs != as_:
            won = diff if hs > as_ else -diff
            weight = np.minimum(math.log(abs(hs - as_) + 1) * 2.2 / (0.001 * (np.where(self.absolute, abs(won), won) if self.any_absolute else won) + 2.2), self.cap)
        moves = self.playoffs if kind == self.post else 1.0
        shift = moves * self.k * weight * (y - p)
        self.r[home], self.r[away] = h + shift, a - shift
        if not neutral:
            self.edge = self.edge + moves * self.step * np.where(self.by_margin, weight, 1.0) * (y - p)


ELO_SCHEMA = "season long, home long, away long, y double, home_pre double, away_pre double, p_elo double, home_post double, away_post double, edge double"


def elo(games: DataFrame, league: Sequence[str], order: Sequence[str], configs: dict[int, Elo] | None = None, game_id: str = "game_id") -> DataFrame:
    """Ratings before and after every game, for each league and configuration.

    Games are replayed in `order`. An expectation from the rating gap and the
    home edge is updated by the result, scaled by the margin; between seasons
    ratings regress to the mean, and sides first seen after the first season
    start as newcomers. With `edge_step` the home edge follows the results.
    Games without a score are forecast only. A column game_type is needed only
    by configurations with `playoffs` False.
    """
    configs = configs or {0: Elo()}
    rows = games.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    kinds = dict(games.dtypes)
    keys = ["config", *league]

    def step(state, pdf):
        out = []
        for r in pdf.itertuples():
            res = state.play(r.season, r.home, r.away, r.home_score, r.away_score, r.neutral, getattr(r, "game_type", None))
            out.append((*[getattr(r, k) for k in keys], getattr(r, game_id), r.season, r.home, r.away, r.y, *res))
        return out

    head = ", ".join(["config int", *[f"{k} {kinds[k]}" for k in league], f"{game_id} {kinds[game_id]}"])
    return keyed_fold(rows, keys, order, lambda key: _EloState(configs[int(key[0])]), step, f"{head}, {ELO_SCHEMA}")


def elo_state(replay: DataFrame, league: Sequence[str], cfg: Elo, order: Sequence[str] = ("season", "game_id")) -> DataFrame:
    """Each side's last rating, and what it will be after the off-season step."""
    sides = replay.select("config", *league, *order, F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_post").alias("post")), F.struct(F.col("away").alias("team"), F.col("away_post").alias("post")))).alias("s"))
    last = sides.groupBy("config", *league, "s.team").agg(F.max_by("s.post", F.struct(*order)).alias("rating"))
    return last.withColumn("next_rating", F.col("rating") + cfg.regress * (cfg.mean - F.col("rating")))


def elo_grid(games: DataFrame, league: Sequence[str], order: Sequence[str], grid: dict[int, Elo], window: tuple[int, int], top: int = 10) -> DataFrame:
    """Replays of all configurations, scored on a window of seasons; the best ones.

    A league's games are read once; each rating is a vector over all
    configurations, and a league sends one row of sums for each of them.
    """
    ids, configs = list(grid), list(grid.values())

    def step(state, pdf):
        kinds = pdf["game_type"].tolist() if "game_type" in pdf else [None] * len(pdf)
        for row in zip(*[pdf[c].tolist() for c in ("season", "home", "away", "home_score", "away_score", "neutral")], kinds, strict=True):
            state.play(*row)
        return []

    end = lambda state: list(zip(ids, [state.n] * len(ids), state.brier.tolist(), state.logloss.tolist(), strict=True))
    sums = keyed_fold(games, league, order, lambda key: _EloGrid(configs, window), step, "config int, n long, brier double, logloss double", end)
    scores = sums.groupBy("config").agg(F.sum("n").alias("n"), (F.sum("brier") / F.sum("n")).alias("brier"), (F.sum("logloss") / F.sum("n")).alias("logloss"))
    return scores.orderBy("brier", "config").limit(top)


@dataclass(frozen=True)
class Kalman:
    """Settings of the state-space filter over sides' levels and the home edge.

    Levels drift by `week_var` a week, and the edge by `edge_drift`; between
    seasons levels shrink by `carry` and gain `season_var`. A margin measures
    the difference of levels plus the edge. A second measurement, times `scale`
    and less `second_edge` at home, measures the difference alone; the noises
    of both correlate by `rho`.
    """

    start_var: float = 36.0
    week_var: float = 0.3
    carry: float = 0.7
    season_var: float = 12.0
    noise_var: float = 160.0
    edge: float = 2.5
    edge_var: float = 0.0
    edge_drift: float = 0.0
    second_var: float = 100.0
    rho: float = 0.0
    scale: float = 1.0
    second_edge: float = 0.0


class _KalmanState:
    """The filter for all settings at once: the first axis of every array is the setting, place 0 of the state the home edge."""

    def __init__(self, configs: Sequence[Kalman]) -> None:
        at = lambda name: np.array([getattr(c, name) for c in configs], float)
        self.start, self.week, self.carry, self.season, self.noise = at("start_var"), at("week_var"), at("carry"), at("season_var"), at("noise_var")
        self.drift, self.second, self.scale, self.second_edge = at("edge_drift"), at("second_var"), at("scale"), at("second_edge")
        self.cross = at("rho") * np.sqrt(self.noise * self.second)
        self.m, self.v = at("edge")[:, None], at("edge_var")[:, None, None]
        self.place, self.period, self.open = {}, None, []

    def _index(self, team) -> int:
        if team not in self.place:
            n = self.m.shape[1]
            self.place[team] = n
            self.m = np.pad(self.m, ((0, 0), (0, 1)))
            self.v = np.pad(self.v, ((0, 0), (0, 1), (0, 1)))
            self.v[:, n, n] = self.start
        return self.place[team]

    def _along(self, i: int, j: int, site: float) -> tuple[np.ndarray, np.ndarray]:
        """The covariances of the state with the expected margin, and with the difference of levels."""
        plain = self.v[:, :, i] - self.v[:, :, j]
        return plain + site * self.v[:, :, 0] if site else plain, plain

    def _learn(self) -> None:
        """The games of the week that has ended, one at a time, with one or both measurements."""
        for i, j, site, margin, second in self.open:
            a, b = self._along(i, j, site)
            gap = self.m[:, i] - self.m[:, j]
            miss = (margin - gap - site * self.m[:, 0])[:, None]
            s = (a[:, i] - a[:, j] + site * a[:, 0] + self.noise)[:, None]
            if second is None:
                gain = a / s
                self.m = self.m + gain * miss
                self.v -= gain[:, :, None] * a[:, None, :]
                continue
            other = (self.scale * (second - self.second_edge * site) - gap)[:, None]
            c = (b[:, i] - b[:, j] + site * b[:, 0] + self.cross)[:, None]
            t = (b[:, i] - b[:, j] + self.second)[:, None]
            whole = s * t - c * c
            first, then = (t * a - c * b) / whole, (s * b - c * a) / whole
            self.m = self.m + first * miss + then * other
            self.v -= np.stack([first, then], axis=2) @ np.stack([a, b], axis=1)
        if self.open:
            self.v = (self.v + self.v.swapaxes(1, 2)) / 2
        self.open = []

    def _pass_time(self, season, week) -> None:
        self._learn()
        if self.period is not None:
            on = np.arange(1, self.m.shape[1])
            if season != self.period[0]:
                self.m[:, 1:] *= self.carry[:, None]
                self.v[:, 1:, :] *= self.carry[:, None, None]
                self.v[:, :, 1:] *= self.carry[:, None, None]
                self.v[:, on, on] += self.season[:, None]
                self.v[:, 0, 0] += self.drift
            else:
                gap = max(week - self.period[1], 1)
                self.v[:, on, on] += gap * self.week[:, None]
                self.v[:, 0, 0] += gap * self.drift
        self.period = (season, week)

    def play(self, season, week, home, away, margin, neutral, second=None):
        """(mean, variance with noise, log density of the margin, of all measurements) for each setting, all before the week's games count."""
        if (season, week) != self.period:
            self._pass_time(season, week)
        i, j, site = self._index(home), self._index(away), 0.0 if neutral else 1.0
        v, gap = self.v, self.m[:, i] - self.m[:, j]
        apart, lean = v[:, i, i] - 2 * v[:, i, j] + v[:, j, j], site * (v[:, 0, i] - v[:, 0, j])
        mean, var = gap + site * self.m[:, 0], apart + 2 * lean + site * v[:, 0, 0] + self.noise
        if margin is None or margin != margin:
            return mean, var, None, None
        second = None if second is None or second != second else float(second)
        self.open.append((i, j, site, float(margin), second))
        miss = margin - mean
        own = -0.5 * (np.log(2 * np.pi * var) + miss**2 / var)
        if second is None:
            return mean, var, own, own
        t, c = apart + self.second, apart + lean + self.cross
        other, whole = self.scale * (second - self.second_edge * site) - gap, var * t - c * c
        both = -0.5 * (2 * np.log(2 * np.pi) + np.log(whole) + (t * miss**2 - 2 * c * miss * other + var * other**2) / whole) + np.log(self.scale)
        return mean, var, own, both


#: Order of a league's games in the filter.
KALMAN_ORDER = ("season", "week", "kickoff", "game_id")


def _games(games: DataFrame, second: str | None) -> DataFrame:
    margin = (F.col("home_score") - F.col("away_score")).cast("double")
    return games.withColumns({"margin": margin, "second_": F.col(second).cast("double") if second else F.lit(None).cast("double")})


def _read(pdf: pd.DataFrame):
    return zip(*[pdf[c].tolist() for c in ("season", "week", "home", "away", "margin", "neutral", "second_")], strict=True)


def kalman(games: DataFrame, league: Sequence[str], configs: dict[int, Kalman] | None = None, second: str | None = None) -> DataFrame:
    """(config, league, game_id, season, week, margin, mean, sd, loglik, joint_loglik) of every game and setting.

    The whole week is predicted before any of its games updates the levels;
    then each game does, with its margin and, where it has one, the measurement
    in the column `second`, by the 2 x 2 covariance of both. Weeks without
    games drift too: by the gap of week numbers. A side starts at level 0 when
    first seen. Games without a margin are only predicted. loglik is the log
    density of the margin, joint_loglik that of all that was measured. All
    settings go through a league together; a league's covariance has the square
    of its sides in entries, so sides should be hundreds rather than thousands.
    """
    configs = configs or {0: Kalman()}
    kinds = dict(games.dtypes)
    ids = list(configs)

    def step(state, pdf):
        out = []
        heads = list(zip(*[pdf[c].tolist() for c in (*league, "game_id", "season", "week", "margin")], strict=True))
        for head, game in zip(heads, _read(pdf), strict=True):
            mean, var, own, both = state.play(*game)
            sd = np.sqrt(var)
            for k, c in enumerate(ids):
                out.append((c, *head, mean[k], sd[k], None if own is None else own[k], None if both is None else both[k]))
        return out

    head = ", ".join(["config int", *[f"{k} {kinds[k]}" for k in league], f"game_id {kinds['game_id']}"])
    return keyed_fold(_games(games, second), league, KALMAN_ORDER, lambda key: _KalmanState(list(configs.values())), step, f"{head}, season long, week long, margin double, mean double, sd double, loglik double, joint_loglik double")


def kalman_profile(games: DataFrame, league: Sequence[str], configs: dict[int, Kalman], seasons: tuple[int, int], second: str | None = None, weeks: tuple[int, int] | None = None) -> DataFrame:
    """(config, n, n_second, loglik, joint_loglik): sums over the played games of a window, for all settings in one replay.

    A league sends one row of sums for each setting. With `weeks`, only games of
    those weeks count (all are replayed), as for a search of the carry-over
    early in a season. Games after the last season aren't read.
    """
    ids = list(configs)

    class Sums(_KalmanState):
        def __init__(self) -> None:
            super().__init__(list(configs.values()))
            self.n, self.both, self.own, self.joint = 0, 0, np.zeros(len(ids)), np.zeros(len(ids))

    def step(state, pdf):
        for game in _read(pdf):
            _, _, own, both = state.play(*game)
            if own is not None and seasons[0] <= game[0] <= seasons[1] and (weeks is None or weeks[0] <= game[1] <= weeks[1]):
                state.n, state.own, state.joint = state.n + 1, state.own + own, state.joint + both
                state.both += game[6] is not None and game[6] == game[6]
        return []

    end = lambda s: list(zip(ids, [s.n] * len(ids), [s.both] * len(ids), s.own.tolist(), s.joint.tolist(), strict=True))
    past = _games(games.where(F.col("season") <= seasons[1]), second)
    sums = keyed_fold(past, league, KALMAN_ORDER, lambda key: Sums(), step, "config int, n long, n_second long, loglik double, joint_loglik double", end)
    return sums.groupBy("config").agg(*[F.sum(c).alias(c) for c in ("n", "n_second", "loglik", "joint_loglik")])
