"""URL filters: explicit rules first, then host reputations shrunk by beta-binomial priors.

Labelled pages make outcomes (good or not) of hosts, registered domains and suffixes. A group's good rate
is drawn around its parent's from a beta distribution, and its outcomes from the rate. What a
level's priors weigh, in outcomes, is fitted to all its groups by moments: two outcomes of one group agree
more often than one outcome each of two siblings, and how much more says how alike siblings are. A group's prior is its parent's
posterior without the group's own outcomes, so none counts twice. A host goes if the upper bound of its posterior
good rate is below ``LEAST_GOOD``: few outcomes leave the bound high, and the host stays.

Groups come by partial aggregation, one row for each host and task. Pages meet the table of hosts once more; it is sent to every task
only if it is counted as small, otherwise the join is shuffled and AQE splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.workspace import materialize

#: Blocked below this upper bound of the good rate, at so many posterior standard deviations.
LEAST_GOOD = 0.5
DEVIATIONS = 1.645
#: Weight of a prior in outcomes: limits, and the value of a level without siblings to learn from.
LIGHTEST, HEAVIEST, USUAL = 1.0, 1000.0, 10.0
#: More hosts (some 50 bytes each) than this are joined by a shuffle.
FEW_HOSTS = 200_000

#: Second-level labels under which countries register names.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path``; a null url or one without ``://`` has both empty."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    cut = pages.selectExpr("page_id", "url", f"coalesce({rest}, '') AS rest")
    cut = cut.selectExpr("page_id", "url", "rest", "split(rest, '[/?#]', 2)[0] AS host")
    return cut.selectExpr(
        "page_id", "url", f"translate(host, '{_UPPER}', '{_LOWER}') AS host",
        "split(substring(rest, length(host) + 1), '[?#]', 2)[0] AS path",
    )


def first_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL for the longest rule that fits and for its verdict; ``rules``: ``(host/path, verdict)``, a short list."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        test = f"({host} = {quote(name)} OR endswith({host}, {quote('.' + name)})) AND startswith({path}, {quote(slash + start)})"
        fits.append((test, quote(rule), quote(verdict)))
    if not fits:
        return "CAST(NULL AS STRING)", "CAST(NULL AS STRING)"
    named = " ".join(f"WHEN {t} THEN {r}" for t, r, _ in fits)
    judged = " ".join(f"WHEN {t} THEN {v}" for t, _, v in fits)
    return f"CASE {named} END", f"CASE {judged} END"


def domains(hosts: DataFrame) -> DataFrame:
    """``hosts`` (``host``) with ``domain`` and ``suffix``; user names and ports are left out.

    The suffix is the last label, or the last two where a country's second level is one of
    ``SECOND_LEVELS``; the domain has one label more. A number address is its own domain, of suffix ``ip``.
    """
    seconds = ", ".join(f"'{s}'" for s in SECOND_LEVELS)
    bare = "regexp_replace(regexp_replace(substring_index(host, '@', -1), ':[0-9]*$', ''), '[.]+$', '')"
    ip = r"(bare RLIKE '^[0-9]+([.][0-9]+){3}$' OR bare LIKE '[%')"
    two = f"length(substring_index(bare, '.', -1)) = 2 AND substring_index(substring_index(bare, '.', -2), '.', 1) IN ({seconds})"
    named = hosts.selectExpr("*", f"{bare} AS bare").selectExpr("*", f"IF({two}, 2, 1) AS depth", f"{ip} AS ip")
    return named.selectExpr(
        *hosts.columns, "IF(ip, bare, substring_index(bare, '.', -1 - depth)) AS domain",
        "IF(ip, 'ip', substring_index(bare, '.', -depth)) AS suffix",
    )


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, k`` of every host: labelled pages, and those that are good by every label of theirs."""
    good = "min(CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 END)"
    marks = labels.selectExpr("doc_id AS page_id", "quality", "toxic").groupBy("page_id").agg(F.expr(good).alias("good"))
    hits = pages.select("page_id", "host").join(marks.where("good IS NOT NULL"), "page_id")
    every = hits.selectExpr("host", "1L AS n", "CAST(good AS LONG) AS k").unionByName(pages.selectExpr("host", "0L AS n", "0L AS k"))
    return every.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _strength(children: DataFrame) -> DataFrame:
    """One row ``strength``: what a prior of this level weighs. ``children``: ``n, k`` and the parent's ``pn, pk``.

    Children of two outcomes or more with a labelled sibling count alike, however large they are.
    Their shares are summed as whole billionths, so the sums do not depend on their order.
    """
    share = lambda x: f"sum(CAST(floor(1e9D * ({x})) AS DECIMAL(20, 0)))"
    sums = children.where("n >= 2 AND pn > n").agg(*map(F.expr, (
        "count(*) AS c", share("k * (k - 1D) / (n * (n - 1D))") + " AS same",
        share("k / CAST(n AS DOUBLE) * ((pk - k) / CAST(pn - n AS DOUBLE))") + " AS apart", share("k / CAST(n AS DOUBLE)") + " AS one",
    )))
    alike = "CAST(same - apart AS DOUBLE) / CAST(one - apart AS DOUBLE)"
    return sums.selectExpr(
        f"CASE WHEN c = 0 OR one <= apart THEN {USUAL}D WHEN same <= apart THEN {HEAVIEST}D"
        f" ELSE least(greatest(1 / ({alike}) - 1, {LIGHTEST}D), {HEAVIEST}D) END AS strength"
    )


def _prior(children: DataFrame) -> DataFrame:
    """``children`` with ``prior``: the parent's posterior mean without the child's own outcomes.

    ``pprior`` is the mean of the parent's own prior, ``pweight`` its weight.
    """
    return children.selectExpr("*", "(pk - k + pweight * pprior) / (pn - n + pweight) AS prior")


def reputations(hosts: DataFrame) -> DataFrame:
    """``host, n, good_rate, bound`` of every row of ``hosts`` (``host, n, k``)."""
    hosts = materialize(domains(hosts), "hosts")
    totals = "sum(n) AS n", "sum(k) AS k"
    named = materialize(hosts.groupBy("suffix", "domain").agg(*map(F.expr, totals)), "domains")
    tops = materialize(named.groupBy("suffix").agg(*map(F.expr, totals)), "suffixes")
    root = tops.selectExpr("struct(coalesce(sum(n), 0L) AS n, coalesce(sum(k), 0L) AS k)")

    tops = tops.withColumn("root", root.scalar()).selectExpr(
        "suffix", "n", "k", "root.n AS pn", "root.k AS pk", "0.5D AS pprior", "2D AS pweight"
    )
    weight = _strength(tops)
    tops = _prior(tops).withColumn("weight", weight.scalar())

    up = tops.selectExpr("suffix", "n AS pn", "k AS pk", "prior AS pprior", "weight AS pweight")
    named = named.join(up, "suffix")
    weight = _strength(named)
    named = _prior(named).withColumn("weight", weight.scalar())

    up = named.selectExpr("suffix", "domain", "n AS pn", "k AS pk", "prior AS pprior", "weight AS pweight")
    hosts = hosts.join(up, ["suffix", "domain"])
    weight = _strength(hosts)
    hosts = _prior(hosts).withColumn("weight", weight.scalar())
    return hosts.selectExpr("host", "n", "weight + n AS total", "(weight * prior + k) / (weight + n) AS good_rate").selectExpr(
        "host", "n", "good_rate", f"good_rate + {DEVIATIONS}D * sqrt(good_rate * (1 - good_rate) / (total + 1)) AS bound"
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], least_good: float = LEAST_GOOD) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, good_rate, bound`` of every row of ``pages`` (``page_id``, ``url``).

    ``labels``: ``doc_id, quality, toxic``; a page takes the labels with its ``page_id``, and is good if quality is 1 and toxic 0 in
    all of them (a null one of the two is ignored, labels with both null count as none). The host goes after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; the path then up to ``?``, ``#`` or the end. A rule ``host/path`` fits its host and all
    subdomains where the url's path starts with the rule's; the longest wins (no two of one length can fit a page unless
    they are equal), and its verdict stands. Other pages go by their host: ``block`` if ``bound < least_good``, else ``allow``.

    Null urls and those without ``://`` have an empty host and path, and share the reputation of the empty host. Repeated rows and null
    ids are kept as given (each row with a label is an outcome). Without labels every host stays. An empty
    table gives none. Other columns, of either table, are ignored.
    """
    cut = parts(pages)
    known = materialize(reputations(outcomes(cut, labels)).select("host", "good_rate", "bound"), "reputations")
    few = known.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS
    rule, verdict = first_rule(rules)
    judged = cut.join(F.broadcast(known) if few else known, "host", "left")
    return judged.selectExpr(
        "page_id", "url", "host", "path", f"{rule} AS rule",
        f"coalesce({verdict}, IF(bound < {float(least_good)!r}D, 'block', 'allow')) AS verdict", "good_rate", "bound",
    )
