"""Check SQL for the named queries: the definitions written out row by row.

It works on its own logic (windows, pivots, row-by-row joins); only the expressions that turn
the given tables into domain tables are shared.
"""

from __future__ import annotations

import re

from burdenflow.catalogue.queries import CLASS_DRAWS, EXACT, TIE
from burdenflow.functions import special as sp
from burdenflow.sources import testbed as tb
from burdenflow.sources.weights import (
    AGE_SHARES,
    DECLINE_RATE,
    DECLINE_SIZE,
    DECLINE_START,
    EXPOSURE_RATE,
)


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


def r(sql: str, name: str | None = None) -> str:
    name = name or sql
    if name in EXACT:
        return f"CAST({sql} AS DOUBLE) AS {name}"
    return f"round(CAST({sql} AS DOUBLE) + CAST({TIE!r} AS DOUBLE), 6) + 0 AS {name}"


def big(sql: str, name: str | None = None) -> str:
    return f"CAST({sql} AS BIGINT) AS {name or sql}"


def horner(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[0])
    for k in coefficients[1:]:
        out = f"({out} * {x} + CAST({k!r} AS DOUBLE))"
    return out


def d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


ORDERS = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""

LONG = """CASE site WHEN 'Kadzinuni-Mauveni' THEN 'Kadziununi-Mauveni (Kilifi C)' WHEN 'Junju' THEN 'Junju (Kilifi B)'
    WHEN 'Ngerenya' THEN 'Ngerenya (Kilifi A)' ELSE site END"""
SHORT = """CASE site WHEN 'Junju (Kilifi B)' THEN 'Kilifi B' WHEN 'Kadziununi-Mauveni (Kilifi C)' THEN 'Kilifi C'
    WHEN 'Ngerenya (Kilifi A)' THEN 'Kilifi A' ELSE site END"""


def _yn(name: str) -> str:
    return f"CASE {name} WHEN 'Y' THEN true WHEN 'N' THEN false END AS {name}"


Q = {"q01": 0.01, "q025": 0.025, "median": 0.5, "q975": 0.975, "q99": 0.99}
M = {"median": 0.5, "q025": 0.025, "q975": 0.975}


def quants(value: str, probs: dict[str, float] = M) -> str:
    return ", ".join(f"quantile_cont({value}, {d(p)}) AS {name}" for name, p in probs.items())


DRAWS = tb.draw_columns(1)
PARAMETERS = [c for c in DRAWS if c not in ("chain", "iteration")]
PRED = {
    "logistic": "intercept + beta1 / (1 + exp(-beta2 * pr))",
    "linear": "intercept + beta1 * pr",
    "intercept": "intercept",
}

CTES = {
    "adm_raw": f"""SELECT {_columns(tb.ADMISSIONS)} FROM lineitem JOIN {ORDERS.replace('orders JOIN', 'orders ON l_orderkey = o_orderkey JOIN', 1)}""",
    "adm_sited": f"""SELECT * REPLACE ({LONG} AS site,
        CASE WHEN period = '1995-1996' THEN '1995-96' ELSE period END AS period) FROM adm_raw""",
    "adm": f"""SELECT site, CASE WHEN site = 'Kadziununi-Mauveni (Kilifi C)' THEN '2018-19' ELSE period END AS period,
        adm_month, adm_year, lower(sex) AS sex, age_years, age_months, temperature,
        CASE fever WHEN 'Y' THEN 'TRUE' WHEN 'N' THEN 'FALSE' ELSE fever END AS fever, fever_days, {_yn('convulsions')},
        fits_per_24h, {_yn('nasal_flaring')}, {_yn('intercostal_recession')}, {_yn('deep_breathing')},
        {_yn('unconscious')}, apvu, bcs, pallor, hb_level, {_yn('transfusion')},
        CASE outcome WHEN 'A' THEN 'Absconded' WHEN 'D' THEN 'Discharged' WHEN 'Unknown' THEN NULL ELSE outcome END AS outcome,
        CASE WHEN sma = 'Y' THEN 'TRUE' ELSE sma END AS sma FROM adm_sited""",
    "patients": f"""SELECT *, study_site || ' ' || period AS study_id FROM (SELECT *, {SHORT} AS study_site FROM adm)""",
    # one more for a transfusion, two more for severe pallor; what is unknown counts as absent
    "evidence4": """SELECT * FROM (VALUES (true, 'severe', 4), (true, 'other', 2), (true, 'unknown', 2),
        (false, 'severe', 3), (false, 'other', 1), (false, 'unknown', 1),
        (NULL, 'severe', 3), (NULL, 'other', 1), (NULL, 'unknown', 1)) AS t(given, pale, c_sma)""",
    "flags": """SELECT study_id, age_years, hb_level, pallor, transfusion, deep_breathing, intercostal_recession, apvu,
        unconscious, bcs, hb_level < 5 AS f_sma, deep_breathing AS f_rd,
        (bcs < 3 OR apvu = 'U' OR unconscious) AS f_cm,
        coalesce(bcs < 3 OR apvu = 'U' OR unconscious, false) AS f_cm0,
        (hb_level < 5 OR deep_breathing OR coalesce(bcs < 3 OR apvu = 'U' OR unconscious, false)) AS f_c,
        (hb_level < 5 OR pallor = 'Severe' OR transfusion OR deep_breathing OR intercostal_recession
            OR coalesce(bcs < 3 OR apvu = 'U' OR unconscious, false)) AS f_alt,
        c_sma,
        CASE WHEN intercostal_recession IS NULL OR NOT intercostal_recession THEN 1 ELSE 2 END AS c_rd
        FROM patients JOIN evidence4 ON transfusion IS NOT DISTINCT FROM given
        AND CASE WHEN pallor IS NULL THEN 'unknown' WHEN pallor = 'Severe' THEN 'severe' ELSE 'other' END = pale""",
    "pop_counts": f"""SELECT n_nationkey, n_name, {tb.POPULATION_PERIOD} AS period, {tb.POPULATION_AGE} AS age_group,
        count(*) AS n FROM {ORDERS} GROUP BY ALL""",
    "pop_parts": f"SELECT {_columns(tb.POPULATION)} FROM pop_counts",
    "pop_read": """SELECT left(file_id, length(file_id) - 8) AS site, right(file_id, 7) AS period,
        CASE WHEN age = '3m-11m' THEN 0 ELSE CAST(nullif(regexp_extract(age, '[0-9]+'), '') AS INT) END AS age_years,
        pyor AS n_age FROM pop_parts""",
    "pop_named": f"SELECT * REPLACE ({LONG} AS site) FROM pop_read",
    "pop_fixed": """SELECT * REPLACE (CASE WHEN period = '2017-19' AND site = 'Kadziununi-Mauveni (Kilifi C)'
        THEN '2018-19' ELSE period END AS period) FROM pop_named""",
    "pop": """SELECT *, CASE WHEN count(*) FILTER (n_age IS NULL) OVER w = 0 THEN sum(n_age) OVER w END AS total_population
        FROM pop_fixed WINDOW w AS (PARTITION BY site, period)""",
    "pop_study": f"""SELECT DISTINCT {SHORT} || ' ' || period AS study_id, total_population AS py FROM pop""",
    "pop_age": f"""SELECT {SHORT} || ' ' || period AS study_id, age_years, n_age FROM pop""",
    "loc_keys": f"""SELECT n_nationkey, o_orderstatus, {_columns(tb.LOCATIONS)} FROM {ORDERS}""",
    "loc_counts": """SELECT n_nationkey, country, site, period, count(*) AS n_examined,
        count(*) FILTER (o_orderstatus = 'P') AS n_positive FROM loc_keys GROUP BY ALL""",
    "loc_raw": f"""SELECT n_nationkey, country, site, period, {_columns(tb.LOCATION_FACTS)}, n_examined, n_positive
        FROM loc_counts""",
    "loc": """SELECT *, pr / pr_c AS r FROM (SELECT * REPLACE (CASE WHEN irs IN ('[N]', 'N') THEN false ELSE true END AS irs),
        n_positive * 1.0 / n_examined * 100 AS pr FROM loc_raw)""",
    "surveys_raw": f"""SELECT {_columns(tb.SURVEYS)}, detection_method FROM loc_raw JOIN nation USING (n_nationkey)""",
    "surveys": """SELECT study_number, v.* FROM (
        SELECT split_part(site, ',', 1) || ' ' || period AS study_id, split_part(site, ',', 1) AS site,
        replace(split_part(site, ',', 2), ' ', '') AS country, period,
        round_even(min_age, 0) + 1 AS min_age, least(round_even(max_age, 0) + 1, 85) AS max_age, number, positives,
        CASE detection_method WHEN 'Microsopy' THEN 'Microscopy' ELSE detection_method END AS detection_method
        FROM surveys_raw) v LEFT JOIN (SELECT study_id, study_number FROM dim) USING (study_id)""",
    "means": """SELECT study_id, study_number, number, positives, min_age - 1 AS mn, max_age - 1 AS mx,
        avg(CAST(positives AS DOUBLE) / number) OVER (PARTITION BY study_id, number, positives) AS pr FROM surveys""",
    "dim": """SELECT dense_rank() OVER (ORDER BY study_id) AS study_number, * FROM
        (SELECT DISTINCT study_id, study_site AS site, period FROM patients)""",
    "known": """SELECT 'sma' AS phenotype, study_id, c_sma AS class, CAST(f_sma AS INT) AS status FROM flags
            WHERE hb_level IS NOT NULL OR pallor IS NOT NULL OR transfusion IS NOT NULL
        UNION ALL SELECT 'rd', study_id, c_rd, CAST(f_rd AS INT) FROM flags
            WHERE deep_breathing IS NOT NULL OR intercostal_recession IS NOT NULL""",
    "rates": """SELECT phenotype, class, sum(status) AS n_positives, count(status) AS n_patients,
        (1.0 + sum(status)) / (2 + count(status)) AS rate FROM known WHERE status IS NOT NULL GROUP BY ALL""",
    "years": "SELECT * FROM (VALUES " + ", ".join(
        f"({age}, {d(w)})" for age, w in enumerate(AGE_SHARES, start=1)) + ") AS t(age, w)",
    # all infections are detected before the decline begins; after it their share falls towards its floor
    "mid_ages": f"SELECT age, w, age - CAST(0.5 AS DOUBLE) AS mid, exp(-{d(DECLINE_SIZE)}) AS lost FROM years",
    "mid_curve": f"""SELECT age, w, 1 - exp(-{d(EXPOSURE_RATE)} * mid) AS p, CASE WHEN mid < {d(DECLINE_START)} THEN 1
        ELSE 1 - lost * (1 - exp({d(DECLINE_RATE)} * ({d(DECLINE_START)} - mid))) END AS f FROM mid_ages""",
    "int_curve": f"""SELECT age, w, (1 - exp(-{d(EXPOSURE_RATE)} * age)) * (1 - CASE WHEN age >= {d(DECLINE_START)} THEN
        (1 - {d(DECLINE_SIZE)}) * (1 - exp(-{d(DECLINE_RATE)} * (age - {d(DECLINE_START)}))) ELSE 0 END) * w AS pfs FROM years""",
    "std": """SELECT m.*, (SELECT sum(p * f * w) / sum(w) FROM mid_curve WHERE age > m.mn AND age <= m.mx) AS k FROM means m""",
    "windows": """SELECT s.*, (SELECT sum(pfs) / sum(w) FROM int_curve WHERE age BETWEEN s.min_age AND s.max_age) AS k,
        (SELECT sum(pfs) / sum(w) FROM int_curve WHERE age BETWEEN 3 AND 10) AS k_ref FROM surveys s""",
    "dw": f"SELECT {_columns(DRAWS)} FROM embeddings",
    "dl": f"SELECT {_columns(tb.DRAWS_LONG)} FROM events",
    "dw_long": "UNPIVOT (SELECT * EXCLUDE (chain, iteration) FROM dw) ON COLUMNS(*) INTO NAME parameter VALUE value",
    "dw_summary": f"SELECT parameter, count(*) AS n, {quants('value', Q)} FROM dw_long GROUP BY parameter",
    "site_dw": " UNION ALL ".join(
        f"""SELECT chain, iteration, CAST({i} AS BIGINT) AS idx, "PR_corrected[{i}]" AS pr,
            "estimated_admissions[{i}]" AS est, intercept, beta1, beta2, r, "alpha_parm[1]" AS a1, "alpha_parm[2]" AS a2,
            "betas[1]" AS b1, "betas[2]" AS b2, sigma, "PR_crit" AS crit FROM dw""" for i in tb.SITE_INDEXES),
    "study_dw": "SELECT d.*, study_number FROM dim JOIN site_dw d ON idx = (study_number - 1) % 20 + 1",
    "upper": """SELECT max(q) AS top FROM (SELECT quantile_cont(pr, CAST(0.975 AS DOUBLE)) AS q FROM study_dw
        GROUP BY study_number)""",
    "cases": """SELECT study_id, count(*) FILTER (f_sma) AS n FROM flags GROUP BY study_id""",
    "study_cases": """SELECT study_number, study_id, n, py FROM cases JOIN dim USING (study_id)
        LEFT JOIN pop_study USING (study_id)""",
    "study_draws": f"""SELECT *, exp({PRED['logistic']} + ln(py)) AS l_logistic, exp({PRED['linear']} + ln(py)) AS l_linear,
        exp(intercept + ln(py)) AS l_intercept FROM study_dw JOIN study_cases USING (study_number)""",
    "profile": """SELECT *, sqrt(m * m + 4 * sigma * sigma) AS root FROM (SELECT *, exp(a2 + b2 * pr) AS m FROM profile_in)""",
    "profile_rated": "SELECT *, 1 + m * ra AS sh FROM (SELECT *, (m + root) / (2 * sigma * sigma) AS ra FROM profile)",
    "profile_led": """SELECT *, lead(age) OVER (PARTITION BY grp, chain, iteration ORDER BY age) AS age_plus
        FROM profile_rated""",
    "profile_weighted": """SELECT *, CASE WHEN pr <= crit THEN 1.0 ELSE
        exp(sh * ln(ra) - lgamma(sh) + (sh - 1) * ln(age_plus) - ra * age_plus) * (age_plus - age) END AS weight
        FROM profile_led WHERE age_plus IS NOT NULL""",
    "profile_fit": """SELECT *, weight / sum(weight) OVER (PARTITION BY grp, chain, iteration)
        * exp(ln(1000) + a1 + b1 * pr) AS fit FROM profile_weighted""",
    "band_in": """SELECT f.*, n_age, CAST(floor(pr / CAST(0.05 AS DOUBLE)) AS BIGINT) AS band FROM flags f
        LEFT JOIN pop_age p ON f.study_id = p.study_id AND f.age_years IS NOT DISTINCT FROM p.age_years
        LEFT JOIN means m ON m.study_id = f.study_id""",
}


def curve(form: str, points: int, top: str, label: str) -> str:
    if form == "intercept":
        bounds = f"(SELECT count(*) AS n, {quants('intercept', Q)} FROM dw)"
        rows = f"SELECT step, step * ({top} / {points - 1}) AS pr, b.* FROM range({points}) t(step), {bounds} b"
    else:
        rows = f"""SELECT step, any_value(pr) AS pr, {quants('fit', Q)} FROM (SELECT step, pr, {PRED[form]} AS fit FROM
            (SELECT dw.*, step, step * ({top} / {points - 1}) AS pr FROM dw, range({points}) t(step))) GROUP BY step"""
    return f"""SELECT '{label}' AS curve, step, pr * 100 AS pr, {', '.join(f'exp({q} + ln(1000)) AS {q}' for q in Q)}
        FROM ({rows})"""


TOP = "(SELECT top FROM upper)"
CURVES = [
    curve("logistic", 500, TOP, "a. anaemia"),
    curve("linear", 100, TOP, "b. respiratory distress"),
    curve("intercept", 100, TOP, "c. cerebral malaria"),
]
CURVE_OUT = f"curve, step, {r('pr')}, {', '.join(r(q) for q in Q)}"


def surface_in(steps: str, per: int) -> str:
    return f"""SELECT chain, iteration, pr_index AS grp, pr_index, CAST(pr_index AS DOUBLE) / {per} AS pr,
        CAST(month AS DOUBLE) / 12 AS age, month AS band, "alpha_parm[1]" AS a1, "alpha_parm[2]" AS a2, "betas[1]" AS b1,
        "betas[2]" AS b2, sigma, "PR_crit" AS crit FROM dw, ({steps}) s(pr_index), range(121) t(month)"""


SURFACE_OUT = f"""SELECT pr_index, band, {r('any_value(pr) * 100', 'pr')}, {r('any_value(age)', 'age')},
    {', '.join(r(f'quantile_cont(fit, {d(p)})', q) for q, p in M.items())},
    {r(f'quantile_cont(fit, {d(0.75)}) - quantile_cont(fit, {d(0.25)})', 'iqr')}"""

SITE_IN = """SELECT site_dw.*, idx AS grp, CASE WHEN b = 0 THEN 0 ELSE b - CAST(0.25 AS DOUBLE) END AS age, b AS band
    FROM site_dw, range(11) t(b) WHERE idx <= 16"""
SITE_FIT = f"""SELECT study_number, g.* EXCLUDE (idx) FROM dim JOIN (SELECT idx, band, any_value(age) AS age, {quants('fit')}
    FROM profile_fit GROUP BY idx, band) g ON g.idx = (study_number - 1) % 16 + 1"""

IRLS_STATS = """sum(w) AS w, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * z) AS wz, sum(w * x * z) AS wxz"""

def probit_sql() -> str:
    u = f"({d(0.180625)} - q * q)"
    tail = lambda num, den, v: f"{horner(v, num)} / {horner(v, den)}"
    return f"""CASE WHEN abs(q) <= 0.425 THEN q * {horner(u, sp.CENTRE_NUM)} / {horner(u, sp.CENTRE_DEN)}
        ELSE sign(q) * CASE WHEN t <= 5 THEN {tail(sp.MIDDLE_NUM, sp.MIDDLE_DEN, '(t - 1.6)')}
        ELSE {tail(sp.TAIL_INV_NUM, sp.TAIL_INV_DEN, '(t - 5)')} END END"""


def cdf_sql() -> str:
    near = f"exp(-z * z / 2) * {horner('z', sp.TAIL_NUM)} / {horner('z', sp.TAIL_DEN)}"
    far = "exp(-z * z / 2) / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631"
    return f"CASE WHEN z > 37 THEN 0 WHEN z < 7.07106781186547 THEN {near} ELSE {far} END"


def detect(source: str) -> str:
    """Adds pr_corrected to rows with pr_mic and detection_method."""
    return f"""SELECT * EXCLUDE (q, t, eta, z, tail), CASE WHEN detection_method = 'RDT' THEN
        CASE WHEN eta > 0 THEN 1 - tail ELSE tail END ELSE pr_mic END AS pr_corrected FROM (
        SELECT *, {cdf_sql()} AS tail FROM (SELECT *, abs(eta) AS z FROM (
        SELECT *, ({probit_sql()}) * 0.97 - 0.22 AS eta FROM (
        SELECT *, sqrt(-ln(least(q + 0.5, 0.5 - q))) AS t FROM (
        SELECT *, greatest(least(pr_mic, {d(1 - 1e-12)}), {d(1e-12)}) - 0.5 AS q FROM {source})))))"""


CTES["points"] = """SELECT *, p_prime * k AS pr_survey, p_prime * k_ref AS pr_mic FROM (SELECT *,
    greatest(least(CAST(positives AS DOUBLE) / number / k, 1), 0) AS p_prime FROM windows)"""
CTES["corrected"] = detect("points")
CTES["drawn_in"] = """SELECT d.study_number, detection_method, pr * k_ref AS pr_mic FROM study_dw d JOIN windows USING (study_number)"""
CTES["drawn"] = detect("drawn_in")


def build(final: str, **extra: str) -> str:
    """Prefix a query with the common tables it needs, in order."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in known:
            if name not in order and re.search(rf'(?<![\w"\'.]){name}\b(?!\()', sql):
                if name in visiting:
                    continue
                visiting.add(name)
                visit(known[name])
                order.append(name)

    visiting: set[str] = set()
    visit(final)
    head = ",\n".join(f"{name} AS ({known[name]})" for name in order)
    return f"WITH RECURSIVE {head}\n{final}" if head else final


def _case_counts(flag: str, where: str = "true") -> str:
    return build(f"""SELECT c.study_id, n, {r('py')}, {r('n / py * 1000', 'rate')} FROM
        (SELECT study_id, count(*) FILTER ({flag}) AS n FROM flags WHERE {where} GROUP BY study_id) c
        LEFT JOIN pop_study USING (study_id)""")


def _undiagnosed(phenotype: str, classes: int) -> str:
    columns = ", ".join(f"count(*) FILTER (status IS NULL AND class = {k}) AS class_{k}" for k in range(1, classes + 1))
    return build(f"SELECT study_id, {columns} FROM known WHERE phenotype = '{phenotype}' GROUP BY study_id")


def _imputed(phenotype: str) -> str:
    return build(f"""SELECT c.study_id, n, coalesce(unknown, 0) AS unknown, {r('n + coalesce(imputed, 0)', 'estimated')},
        {r('py')}, {r('(n + coalesce(imputed, 0)) / py * 1000', 'rate_estimated')} FROM
        (SELECT study_id, count(*) FILTER (f_{phenotype}) AS n FROM flags GROUP BY study_id) c
        LEFT JOIN (SELECT study_id, count(*) FILTER (status IS NULL) AS unknown,
            sum(CASE WHEN status IS NULL THEN coalesce(rate, 0.5) ELSE 0 END) AS imputed FROM known
            LEFT JOIN rates USING (phenotype, class) WHERE phenotype = '{phenotype}' GROUP BY study_id) u USING (study_id)
        LEFT JOIN pop_study USING (study_id)""")


COMPOSITE_ROWS = """SELECT f.*, CASE WHEN f_c THEN 1 ELSE 0 END AS seen,
    1 - (1 - coalesce(CAST(f_sma AS DOUBLE), s.rate, 0.5)) * (1 - coalesce(CAST(f_rd AS DOUBLE), d.rate, 0.5))
        * (1 - CAST(f_cm0 AS DOUBLE)) AS any_case FROM flags f
    LEFT JOIN rates s ON s.phenotype = 'sma' AND s.class = c_sma LEFT JOIN rates d ON d.phenotype = 'rd' AND d.class = c_rd"""



def halved(source: str, columns: str, share: str) -> str:
    """Beta quantiles by halving: with whole numbers the distribution function is a binomial tail, summed where it has weight."""
    n, spread = "(m + 1)", "(12 * sqrt((m + 1) * x * (1 - x)) + 60)"
    term = f"""exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln(x) + ({n} - j) * ln(1 - x))"""
    first, last = f"greatest(k + 1, CAST(floor({n} * x - {spread}) AS BIGINT))", f"least({n}, CAST(ceil(greatest(k + 1, {n} * x) + {spread}) AS BIGINT))"
    tail = f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda j: {term})), 0.0)"
    return f"""WITH RECURSIVE steps AS (SELECT {columns}, CAST(n_positives AS BIGINT) AS k, CAST(n_patients AS BIGINT) AS m,
            CAST({share} AS DOUBLE) AS p, 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high FROM {source}
        UNION ALL SELECT {columns}, k, m, p, step + 1, CASE WHEN f < p THEN x ELSE low END, CASE WHEN f < p THEN high ELSE x END
        FROM (SELECT *, {tail} AS f FROM (SELECT *, (low + high) / 2 AS x FROM steps WHERE step < 48)))
        SELECT {columns}, p, (low + high) / 2 AS value FROM steps WHERE step = 48"""


CLASS_BOUNDS = {"median": 0.5, "q025": 0.025, "q975": 0.975}


def _imputed_draws(keys: str) -> str:
    shown = ", ".join(
        r(f"round(observed + coalesce(quantile_cont(cases, {d(p)}), 0) + {d(TIE)}, 3)", f"estimated_{name}") for name, p in CLASS_BOUNDS.items()
    )
    named = ", ".join(k if k == "study_id" else big(k) for k in keys.split(", "))
    return build(f"""SELECT {named}, {big('observed')}, {big('patients')}, {shown} FROM group_counts LEFT JOIN group_draws USING (g)
            GROUP BY {keys}, observed, patients""",
        drawn=f"""SELECT phenotype, class, i, value AS rate FROM ({halved("(SELECT * FROM rates, range(1, " + str(CLASS_DRAWS + 1) + ") t(i))",
            "phenotype, class, i", "(('0x' || substr(md5('1:' || phenotype || ':' || class || ':' || i), 1, 12))::BIGINT + 0.5::DOUBLE) / pow(2::DOUBLE, 48)")})""",
        group_rows=f"SELECT *, dense_rank() OVER (ORDER BY {keys}) AS g FROM flags",
        group_counts=f"""SELECT g, {keys}, count(*) FILTER (f_c) AS observed, count(*) AS patients FROM group_rows GROUP BY ALL""",
        group_open="""SELECT g, f_sma, f_rd, c_sma, c_rd, count(*) AS n FROM group_rows
            WHERE f_c IS NULL GROUP BY ALL""",
        group_draws=f"""SELECT g, t.i, sum(n * (1 - CASE WHEN f_sma IS NULL THEN 1 - coalesce(s.rate, 0.5) ELSE 1 END
            * CASE WHEN f_rd IS NULL THEN 1 - coalesce(b.rate, 0.5) ELSE 1 END)) AS cases
            FROM group_open CROSS JOIN range(1, {CLASS_DRAWS + 1}) t(i)
            LEFT JOIN drawn s ON s.phenotype = 'sma' AND s.class = c_sma AND s.i = t.i
            LEFT JOIN drawn b ON b.phenotype = 'rd' AND b.class = c_rd AND b.i = t.i GROUP BY g, t.i""")


AGE_BANDS = """CASE WHEN age_years = 0 THEN 0 ELSE age_years - 0.25 END"""
BAND_COLUMNS = f"""{r('age_start')}, {r('CASE WHEN age_start = 0 THEN 0.75 ELSE age_start + 1 END', 'age_end')},
    {r('CASE WHEN age_start = 0 THEN 0.75 WHEN age_start IS NOT NULL THEN 1 END', 'age_width')}"""
AGE_RATES = """count(*) FILTER (f_c) AS n, count(*) FILTER (f_alt) AS n_alt,
    CASE WHEN count(*) FILTER (n_age IS NULL) = 0 THEN sum(DISTINCT n_age) END AS py"""

CLEAN_OUT = f"""site, period, {big('adm_month')}, {big('adm_year')}, sex, {big('age_years')}, {r('age_months')},
    {r('temperature')}, fever, {r('fever_days')}, convulsions, {r('fits_per_24h')}, nasal_flaring, intercostal_recession,
    deep_breathing, unconscious, apvu, {big('bcs')}, pallor, {r('hb_level')}, transfusion, outcome, sma"""
PLACE_OUT = ["latitude", "longitude", "hbas", "hospital_min_dist", "hospital_max_dist", "itn"]
COMBINED = build(f"""SELECT {re.sub(r'(?<![a-z_])(site|period|age_years)(?![a-z_])', r'a.\1', CLEAN_OUT).replace('AS a.', 'AS ')},
    country, pr_dates, detection_method, {', '.join(r(c) for c in PLACE_OUT)}, irs, {r('rainfall')}, {r('altitude')},
    {r('pr_c')}, n_examined, n_positive, {r('pr')}, {r('r')}, {r('n_age')}, {r('total_population')} FROM adm a
    LEFT JOIN loc l ON a.site IS NOT DISTINCT FROM l.site AND a.period IS NOT DISTINCT FROM l.period
    LEFT JOIN pop p ON a.site IS NOT DISTINCT FROM p.site AND a.period IS NOT DISTINCT FROM p.period
        AND a.age_years IS NOT DISTINCT FROM p.age_years""")
SURVEYS_OUT = build(f"""SELECT study_number, study_id, site, country, period, {big('min_age')}, {big('max_age')}, number,
    positives, detection_method FROM surveys""")
STANDARD = build(f"""SELECT study_id, study_number, number, positives, {big('mn')}, {big('mx')}, {r('pr')}, {r('k')}, {r('x')},
    {r('x * (SELECT sum(p * f * w) / sum(w) FROM mid_curve WHERE age BETWEEN 3 AND 9)', 'pr_std')},
    {r('x * (SELECT sum(p * f * w) / sum(w) FROM mid_curve)', 'pr_all')}
    FROM (SELECT *, greatest(least(pr / k, 1), 0) AS x FROM std)""")

LOGLIK = {
    "poisson_logistic": ("l_logistic", "poisson"),
    "nb_logistic": ("l_logistic", "nb"),
    "nb_linear": ("l_linear", "nb"),
    "nb_intercept": ("l_intercept", "nb"),
}


def _deviance(model: str, source: str = "study_draws", corrected: bool = True) -> str:
    lam, family = LOGLIK[model]
    mu = f"({lam} * CASE WHEN est > 0 THEN {lam} / est ELSE 1 END)" if corrected else lam
    if family == "poisson":
        value = "n * ln(mu) - mu - lgamma(n + 1)"
    else:
        value = "lgamma(n + r) - lgamma(r) - lgamma(n + 1) + r * ln(r / (r + mu)) + n * ln(1 - r / (r + mu))"
    return f"""SELECT '{model}' AS model, chain, iteration, -2 * sum({value}) AS dev
        FROM (SELECT *, {mu} AS mu FROM {source}) GROUP BY chain, iteration"""


def _scores(source: str, corrected: bool = True) -> str:
    return f"""SELECT model, avg(dev) AS d_bar, var_samp(dev) / 2 AS p_d, avg(dev) + var_samp(dev) / 2 AS dic
        FROM ({' UNION ALL '.join(_deviance(m, source, corrected) for m in LOGLIK)}) GROUP BY model"""


def _counted(flag: str, where: str = "true") -> str:
    """Draws of every study beside its cases of another phenotype."""
    return f"""SELECT s.* EXCLUDE (n), c.n FROM study_draws s JOIN (SELECT study_id, count(*) FILTER ({flag}) AS n FROM flags
        WHERE {where} GROUP BY study_id) c USING (study_id)"""


SCORES, SCORES_CM = _scores("study_draws"), _scores("cm_draws", False)
CM_DRAWS = _counted("f_cm", "NOT (apvu IS NULL AND unconscious IS NULL AND bcs IS NULL)")


def _irls(name: str, feature: str, start: str) -> str:
    """Recursive table (step, g, shape, a, b, r): weighted least squares until step 40; a missing r is Poisson."""
    slopes = ("(wxx * wz - wx * wxz) / (w * wxx - wx * wx)", "(w * wxz - wx * wz) / (w * wxx - wx * wx)")
    a, b = ("wz / w", "0") if feature == "0" else slopes
    return f"""SELECT 0 AS step, g, CAST(shape AS DOUBLE) AS shape, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b,
        CAST(r AS DOUBLE) AS r FROM ({start}) UNION ALL
        SELECT step + 1, g, shape, {a}, {b}, r FROM (
        SELECT step, g, shape, r, {IRLS_STATS} FROM (
        SELECT *, CASE WHEN r IS NULL THEN mu ELSE mu / (1 + mu / r) END AS w, eta + (n - mu) / mu AS z FROM (
        SELECT *, exp(eta) * py AS mu FROM (SELECT step, g, shape, r, n, py, f AS x, a + b * f AS eta FROM (
        SELECT it.*, reg.n, reg.py, {feature} AS f FROM {name} it, reg) WHERE step < 40))) GROUP BY step, g, shape, r)"""


POISSON_LL = "n * ln(mu) - mu - lgamma(n + 1)"
NB_LL = f"""CASE WHEN r IS NULL THEN {POISSON_LL}
    ELSE lgamma(n + r) - lgamma(r) - lgamma(n + 1) + r * ln(r / (r + mu)) + n * ln(1 - r / (r + mu)) END"""
FEATURES = {"linear": "reg.x", "intercept": "0", "logistic": "1 / (1 + exp(-it.shape * reg.x))"}
# shapes tried first, and how often and into how many parts the best one's surroundings are cut
SHAPES = [k / 2 for k in range(1, 21)] + list(range(11, 21))
LEVELS, CUTS = 2, 20


def _level(family: str, form: str, shapes: str, level: int) -> dict[str, str]:
    """Tables of one level: fits from a Poisson start, the second with the dispersion by moments, and their scores."""
    first, second, feature = f"fit{level}", f"refit{level}", FEATURES[form]
    out = {
        f"start{level}": f"""SELECT g, shape, lna AS a, 0 AS b, NULL AS r
            FROM ({shapes}), (SELECT ln(sum(n) / sum(py)) AS lna FROM reg)""",
        first: _irls(first, feature, f"SELECT * FROM start{level}"),
    }
    last = first
    if family == "negbin":
        out[f"moments{level}"] = f"""SELECT g, shape, a, b, CASE WHEN sum((n - mu) * (n - mu) - mu) > 0
            THEN sum(mu * mu) / sum((n - mu) * (n - mu) - mu) END AS r FROM (
            SELECT it.*, n, exp(a + b * {feature}) * py AS mu FROM {first} it, reg WHERE step = 40) GROUP BY g, shape, a, b"""
        out[second] = _irls(second, feature, f"SELECT * FROM moments{level}")
        last = second
    out[f"scored{level}"] = f"""SELECT g, shape, a, b, r, sum({POISSON_LL if family == 'poisson' else NB_LL}) AS ll,
        count(*) AS studies FROM (SELECT it.*, n, exp(a + b * {feature}) * py AS mu FROM {last} it, reg WHERE step = 40)
        GROUP BY g, shape, a, b, r"""
    return out


def _regression(family: str, form: str, flag: str = "f_sma", where: str = "true") -> str:
    extra = {"reg": f"""SELECT CAST(c.n AS DOUBLE) AS n, s.py, p.pr_corrected AS x FROM
        (SELECT study_id, count(*) FILTER ({flag}) AS n FROM flags WHERE {where} GROUP BY study_id) c
        JOIN pop_study s USING (study_id) JOIN corrected p USING (study_id) WHERE s.py > 0"""}
    last = LEVELS if form == "logistic" else 0
    values = ", ".join(f"({g}, {d(float(v))})" for g, v in enumerate(SHAPES)) if last else "(0, NULL)"
    extra |= _level(family, form, f"SELECT * FROM (VALUES {values}) AS t(g, shape)", 0)
    for level in range(1, last + 1):
        before = level - 1
        extra[f"around{level}"] = f"""SELECT coalesce(lag(shape) OVER w, shape) AS low, coalesce(lead(shape) OVER w, shape) AS high,
            row_number() OVER (ORDER BY ll DESC, g) AS place FROM scored{before} WINDOW w AS (ORDER BY g)"""
        cut = f"""SELECT k AS g, low + (high - low) * (CAST(k AS DOUBLE) / {CUTS}) AS shape
            FROM around{level}, range({CUTS + 1}) t(k) WHERE place = 1"""
        extra |= _level(family, form, cut, level)
    return build(f"""SELECT '{family}' AS family, '{form}' AS form, {r('a', 'intercept')}, {r('b', 'beta1')},
        {r('shape', 'beta2')}, {r('r')}, {r('ll', 'log_lik')}, studies, true AS converged
        FROM scored{last} ORDER BY ll DESC, g LIMIT 1""", **extra)


def _points(label: str, names, source: str, observed: bool = False) -> str:
    rates = ", ".join(
        r("o.n / py * 1000" if q == "median" else "NULL", f"rate_{q}") if observed else r(f"e.{q} / py * 1000", f"rate_{q}")
        for q in names
    )
    counted = """(SELECT study_id, count(*) FILTER (f_cm) AS n FROM flags
        WHERE NOT (apvu IS NULL AND unconscious IS NULL AND bcs IS NULL) GROUP BY study_id)"""
    return f"""SELECT '{label}' AS curve, study_number, study_id, detection_method, {r('100 * pr_mic', 'pr_survey_mic')},
        {r('100 * pr_corrected', 'pr_survey')}, {', '.join(r(f'100 * p.{q}', f'pr_{q}') for q in names)}, {rates}
        FROM dim LEFT JOIN pop_study USING (study_id)
        LEFT JOIN (SELECT study_id, detection_method, pr_mic, pr_corrected FROM corrected) USING (study_id)
        LEFT JOIN {counted} o USING (study_id)
        LEFT JOIN {source} p ON p.parameter = 'PR_corrected[' || ((study_number - 1) % 20 + 1) || ']'
        LEFT JOIN {source} e ON e.parameter = 'estimated_admissions[' || ((study_number - 1) % 20 + 1) || ']'"""


ORACLE = {
    "clean_admissions": build(f"SELECT {CLEAN_OUT} FROM adm"),
    "phenotype_flags_raw": build(f"""SELECT {big('bcs')}, apvu, unconscious, deep_breathing, sma,
        {big("CASE WHEN bcs < 3 OR unconscious = 'Y' OR apvu = 'U' THEN 1 ELSE 0 END", 'cerebral_raw')},
        {big('CASE WHEN sma IS NULL THEN 0 ELSE 1 END', 'anemia_raw')},
        {big("CASE WHEN deep_breathing = 'Y' THEN 1 ELSE 0 END", 'respiratory_raw')} FROM adm_raw"""),
    "phenotype_flags": build(f"""SELECT study_id, f_sma AS sma, f_rd AS rd, f_cm0 AS cm, f_c AS composite,
        f_alt AS composite_alt, {big('c_sma', 'class_sma')}, {big('c_rd', 'class_rd')} FROM flags"""),
    "age_population_union": build(f"SELECT site, period, {big('age_years')}, {r('n_age')}, {r('total_population')} FROM pop"),
    "location_features": build(f"""SELECT country, site, period, pr_dates, detection_method,
        {', '.join(r(c) for c in PLACE_OUT)}, irs, {r('rainfall')}, {r('altitude')}, {r('pr_c')}, n_examined, n_positive,
        {r('pr')}, {r('r')} FROM loc"""),
    "combined_left_joins": COMBINED,
    "study_dimension": build("SELECT study_number, study_id, site, period FROM dim"),
    "survey_format": SURVEYS_OUT,
    "survey_group_mean": build(f"SELECT study_id, study_number, number, positives, {big('mn')}, {big('mx')}, {r('pr')} FROM means"),
    "case_counts_sma": _case_counts("f_sma"),
    "case_counts_rd": _case_counts("f_rd"),
    "case_counts_cm": _case_counts("f_cm", "NOT (apvu IS NULL AND unconscious IS NULL AND bcs IS NULL)"),
    "case_counts_composite": _case_counts("f_c"),
    "evidence_class_counts": build(f"""SELECT phenotype, study_id, {big('class')}, {big('sum(status)', 'n_positives')},
        count(*) AS n_patients FROM known WHERE status IS NOT NULL GROUP BY phenotype, study_id, class"""),
    "undiagnosed_pivot": _undiagnosed("sma", 4),
    "undiagnosed_pivot_rd": _undiagnosed("rd", 2),
    "class_positivity": build(f"""SELECT phenotype, {big('class')}, {big('n_positives')}, n_patients, {r('rate', 'rate_mean')},
        {r('(n_positives + 1.0) * (n_patients - n_positives + 1.0) / (pow(n_patients + 2.0, 2) * (n_patients + 3.0))', 'rate_var')},
        {', '.join(r(f'(SELECT value FROM bounds b WHERE b.phenotype = rates.phenotype AND b.class = rates.class AND b.p = {p})', f'rate_{q}') for q, p in CLASS_BOUNDS.items())}
        FROM rates""",
        bounds=halved("(SELECT * FROM rates, (VALUES (0.5), (0.025), (0.975)) t(share))", "phenotype, class", "share")),
    "imputed_admissions": _imputed("sma"),
    "imputed_admissions_rd": _imputed("rd"),
    "composite_imputed": build(f"""SELECT study_id, {big('sum(seen)', 'observed')}, count(*) AS patients,
        {r('sum(any_case)', 'estimated')} FROM ({COMPOSITE_ROWS}) GROUP BY study_id"""),
    "composite_imputed_by_age": build(f"""SELECT study_id, {big('age_years')}, observed, patients, {r('estimated')}, {BAND_COLUMNS}
        FROM (SELECT study_id, age_years, {AGE_BANDS} AS age_start, {big('sum(seen)', 'observed')}, count(*) AS patients,
        sum(any_case) AS estimated FROM ({COMPOSITE_ROWS}) GROUP BY study_id, age_years)"""),
    "composite_imputed_draws": _imputed_draws("study_id"),
    "composite_imputed_draws_by_age": _imputed_draws("study_id, age_years"),
    "row_ranges": build("""SELECT study_id, min(rn) AS min_index, max(rn) AS max_index FROM
        (SELECT study_id, row_number() OVER (ORDER BY study_id) AS rn FROM flags) GROUP BY study_id"""),
    "age_band_rates": build(f"""SELECT {big('age_years')}, band, n, n_alt, {r('py')}, {r('n / py * 1000', 'rate')},
        {r('n_alt / py * 1000', 'rate_alt')}, {BAND_COLUMNS} FROM (SELECT age_years, band, {AGE_BANDS} AS age_start, {AGE_RATES}
        FROM band_in GROUP BY age_years, band)"""),
    "age_curve": build(f"""SELECT {big('age')}, (SELECT count(*) FROM adm WHERE age_years + 1 = c.age) AS patients, {r('w')},
        {r('p')}, {r('f')}, {r('p * f * w', 'pfs')}, {r('cum_w')}, {r('cum_pfs')} FROM (SELECT *,
        sum(w) OVER (ORDER BY age) AS cum_w, sum(p * f * w) OVER (ORDER BY age) AS cum_pfs FROM mid_curve) c"""),
    "standardise_prevalence": STANDARD,
    "standardise_prevalence_prefix": STANDARD,
    "corrected_prevalence": build(f"""SELECT study_id, detection_method, {r('k')}, {r('p_prime')}, {r('pr_survey')},
        {r('pr_mic')}, {r('pr_corrected')} FROM corrected"""),
    "drawn_prevalence": build(f"""SELECT study_number, n, {', '.join(r(q) for q in M)} FROM (SELECT study_number, count(*) AS n,
        {quants('pr_corrected')} FROM drawn GROUP BY study_number)"""),
    "posterior_summary": build(f"SELECT parameter, n, {', '.join(r(q) for q in Q)} FROM dw_summary"),
    "posterior_summary_by_model": build(f"""SELECT model, parameter, n, {', '.join(r(q) for q in Q)} FROM (SELECT model, parameter,
        count(value) AS n, {quants('value', Q)} FROM (SELECT model, parameter, value FROM dl
        UNION ALL SELECT 'joint', parameter, value FROM dw_long) GROUP BY model, parameter)"""),
    "posterior_quantiles_long": build(f"""SELECT parameter, n, {', '.join(r(q) for q in Q)} FROM (SELECT parameter,
        count(value) AS n, {quants('value', Q)} FROM dl GROUP BY parameter)"""),
    "posterior_hdi": build(f"""SELECT parameter, n, {r('arg_min(lo, [width, lo])', 'lower')}, {r('arg_min(hi, [width, lo])', 'upper')}
        FROM (SELECT a.parameter, a.n, a.value AS lo, b.value AS hi, b.value - a.value AS width FROM sorted a JOIN sorted b
        ON a.parameter = b.parameter AND b.i = a.i + floor(a.n * 0.95)) GROUP BY parameter, n""",
        sorted="""SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value) AS i,
            count(*) OVER (PARTITION BY parameter) AS n FROM dl"""),
    "composite_summary": build(f"""SELECT parameter, {r('med', 'median')}, n, {r('arg_min(lo, [width, lo])', 'lower')},
        {r('arg_min(hi, [width, lo])', 'upper')}
        FROM (SELECT a.parameter, a.n, a.med, a.value AS lo, b.value AS hi, b.value - a.value AS width FROM ranked a
        JOIN ranked b ON a.parameter = b.parameter AND b.i = a.i + floor(a.n * 0.95)) GROUP BY parameter, n, med""",
        ranked="""SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value) AS i,
            count(*) OVER (PARTITION BY parameter) AS n, median(value) OVER (PARTITION BY parameter) AS med FROM dw_long"""),
    "fold_change": build(f"""SELECT CAST(25 AS DOUBLE) AS points, n, {', '.join(r(q) for q in M)} FROM (SELECT count(*) AS n,
        {quants('exp(beta1 * 0.25)')} FROM dw)"""),
    "sampled_site_draws": build(f"""SELECT {big('chain')}, iteration, {big('study_number')}, {r('re')}, {r('pr')} FROM (
        {' UNION ALL '.join(f'SELECT chain, iteration, {i} AS study_number, "RE[{i}]" AS re, "PR_corrected[{i}]" AS pr FROM picked' for i in tb.EFFECT_INDEXES)})""",
        picked="SELECT * FROM dw ORDER BY md5('7:' || chain || ':' || iteration) LIMIT 200"),
    "site_age_steps": build(f"""SELECT study_id, {big('age_years')}, n, n_alt, {r('py')}, {r('n / py * 1000', 'rate')},
        {r('n_alt / py * 1000', 'rate_alt')}, rn, {big('lead(age_years) OVER (PARTITION BY study_id ORDER BY age_years)', 'age_plus')}
        FROM (SELECT *, row_number() OVER (ORDER BY study_id, age_years NULLS LAST) AS rn FROM
            (SELECT study_id, age_years, {AGE_RATES} FROM band_in GROUP BY study_id, age_years)) WHERE age_years IS NOT NULL"""),
    "parameter_families": build(f"""SELECT parameter, {big("regexp_extract(parameter, '[0-9]+')", 'number')}, count(*) AS n,
        {r('avg(value)', 'mean')} FROM dl WHERE regexp_matches(parameter, '^(click|view|error)') AND parameter NOT LIKE '%error%'
        GROUP BY parameter"""),
    "chain_diagnostics": build(f"""SELECT t.parameter, {big('t.n', 'n')}, chains, {r('t.mean', 'mean')}, {r('t.sd', 'sd')},
        {r('sqrt(((length - 1) / length * within + between_means) / within)', 'r_hat')}, {r('acf_1')}, {r('acf_10')}
        FROM (SELECT parameter, count(*) AS chains, avg(n) AS length, avg(v) AS within, var_samp(mean) AS between_means,
            avg(a1) AS acf_1, avg(a10) AS acf_10 FROM (SELECT parameter, chain, count(*) AS n, avg(value) AS mean,
            var_samp(value) AS v, corr(value, l1) AS a1, corr(value, l10) AS a10 FROM lagged GROUP BY parameter, chain)
            GROUP BY parameter) c
        JOIN (SELECT parameter, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM lagged GROUP BY parameter) t
        USING (parameter)""",
        lagged="""SELECT *, lag(value, 1) OVER w AS l1, lag(value, 10) OVER w AS l10 FROM
            (UNPIVOT dw ON COLUMNS(* EXCLUDE (chain, iteration)) INTO NAME parameter VALUE value)
            WINDOW w AS (PARTITION BY parameter, chain ORDER BY iteration)"""),
    "sampled_draws": build(f"""SELECT {big('chain')}, iteration, {r('beta1')}, {r('beta2')}, {r('"alpha_parm[1]"', 'alpha_parm1')},
        {r('"alpha_parm[2]"', 'alpha_parm2')}, {r('"betas[1]"', 'betas1')}, {r('"betas[2]"', 'betas2')}, {r('sigma')},
        {r('"PR_crit"', 'PR_crit')} FROM dw ORDER BY md5('7:' || chain || ':' || iteration) LIMIT 200"""),
    "curve_linear": build(f"SELECT {CURVE_OUT} FROM ({curve('linear', 1000, d(0.75), 'composite')})"),
    "curve_logistic": build(f"SELECT {CURVE_OUT} FROM ({CURVES[0]})"),
    "curve_constant": build(f"SELECT {CURVE_OUT} FROM ({CURVES[2]})"),
    "curves_union": build(f"""SELECT {CURVE_OUT}, place, {r('max(q99) OVER ()', 'rate_max')} FROM
        ({' UNION ALL '.join(f'SELECT *, CAST({i} AS BIGINT) AS place FROM ({sql})' for i, sql in enumerate(CURVES, start=1))})"""),
    "curve_points": build(" UNION ALL ".join(_points(label, Q, f"own_{k}", k == 2) for k, label in enumerate(
        ("a. anaemia", "b. respiratory distress", "c. cerebral malaria"))), **{f"own_{k}": f"""SELECT parameter, {quants('value', Q)}
        FROM (UNPIVOT (SELECT * EXCLUDE (chain, iteration) FROM dw WHERE iteration % 3 = {k}) ON COLUMNS(*) INTO NAME parameter VALUE value)
        GROUP BY parameter""" for k in range(3)}),
    "curve_points_composite": build(_points("composite", ("median", "lower", "upper"), "dense"),
        dense="""SELECT parameter, med AS median, n, arg_min(lo, [width, lo]) AS lower, arg_min(hi, [width, lo]) AS upper
        FROM (SELECT a.parameter, a.n, a.med, a.value AS lo, b.value AS hi, b.value - a.value AS width FROM ranked a
        JOIN ranked b ON a.parameter = b.parameter AND b.i = a.i + floor(a.n * 0.95)) GROUP BY parameter, n, med""",
        ranked="""SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value) AS i,
            count(*) OVER (PARTITION BY parameter) AS n, median(value) OVER (PARTITION BY parameter) AS med FROM dw_long"""),
    "modal_age": build(f"""SELECT pr_index, {r('pr')}, {', '.join(r(f'exp({q})', f'age_{q}') for q in M)} FROM (
        SELECT pr_index, CAST(pr_index AS DOUBLE) / 100 * 100 AS pr, {quants('"alpha_parm[2]" + "betas[2]" * (CAST(pr_index AS DOUBLE) / 100)')}
        FROM dw, range(76) t(pr_index) GROUP BY pr_index)
        WHERE pr >= 0.993 * (SELECT 100 * quantile_cont("PR_crit", {d(0.5)}) FROM dw)"""),
    "threshold_summary": build(f"""SELECT {', '.join(r(f'100 * {q}', f'cut_{q}') for q in M)} FROM
        (SELECT {quants('"PR_crit"')} FROM dw)"""),
    "age_surface": build(f"{SURFACE_OUT} FROM profile_fit GROUP BY pr_index, band",
        profile_in=surface_in("SELECT range FROM range(76)", 100)),
    "age_profiles": build(f"""{SURFACE_OUT}, CASE WHEN pr_index = 0 THEN '<1%' ELSE pr_index || '%' END AS label
        FROM profile_fit GROUP BY pr_index, band""", profile_in=surface_in("SELECT range * 25 FROM range(4)", 100)),
    "site_age_fit": build(f"""SELECT study_number, band, {r('age')}, {', '.join(r(f'f.{q}', q) for q in M)},
        {', '.join(r(f'100 * p.{q}', f'pr_{q}') for q in M)}, row_number() OVER (PARTITION BY band ORDER BY p.median, study_number)
        AS position, study_id FROM ({SITE_FIT}) f JOIN (SELECT study_number, {quants('pr')} FROM dim
            JOIN site_dw ON idx = (study_number - 1) % 16 + 1 GROUP BY study_number) p USING (study_number) LEFT JOIN dim USING (study_number)""", profile_in=SITE_IN),
    "site_age_observed": build(f"""SELECT coalesce(f.study_id, o.study_id) AS study_id, {big('coalesce(f.quarter, o.quarter)', 'quarter')},
        {', '.join(r(f'f.{q}', f'fit_{q}') for q in M)}, rn, n, n_alt, {r('py')}, {r('n / py * 1000', 'rate')},
        {r('n_alt / py * 1000', 'rate_alt')}, {', '.join(r(f'o.{q} / py * 1000', f'site_{q}') for q in M)}
        FROM (SELECT study_id, CAST(age * 4 AS BIGINT) AS quarter, {', '.join(M)} FROM ({SITE_FIT}) LEFT JOIN dim USING (study_number)) f
        FULL JOIN (SELECT *, CASE WHEN age_years > 0 THEN age_years * 4 - 1 ELSE age_years * 4 END AS quarter FROM
            numbered LEFT JOIN (SELECT idx, {quants('value')} FROM dl GROUP BY idx) q ON q.idx = (rn - 1) % 10) o
        ON f.study_id IS NOT DISTINCT FROM o.study_id AND f.quarter IS NOT DISTINCT FROM o.quarter""", profile_in=SITE_IN,
        numbered=f"""SELECT *, row_number() OVER (ORDER BY study_id, age_years NULLS LAST) AS rn FROM
            (SELECT study_id, age_years, {AGE_RATES} FROM band_in GROUP BY study_id, age_years)"""),
    "expected_rates": build(f"""SELECT {big('chain')}, iteration, study_number, {r('l_logistic', 'lambda_logistic')},
        {r('l_linear', 'lambda_linear')}, {r('l_intercept', 'lambda_intercept')},
        {r('CASE WHEN est > 0 THEN l_linear / est ELSE 1 END', 'correction')} FROM study_draws"""),
    "model_scores": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'sma' AS phenotype,
        {r('dic - min(dic) OVER ()', 'delta')} FROM ({SCORES})"""),
    "model_scores_cm": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'cm' AS phenotype,
        {r('dic - min(dic) OVER ()', 'delta')} FROM ({SCORES_CM})""", cm_draws=CM_DRAWS),
    "model_scores_rd": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'rd' AS phenotype,
        {r('dic - min(dic) OVER ()', 'delta')} FROM ({_scores('rd_draws')})""", rd_draws=_counted("f_rd")),
    "model_scores_composite": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'composite' AS phenotype,
        {r('dic - min(dic) OVER ()', 'delta')} FROM ({_scores('composite_draws')})""", composite_draws=_counted("f_c")),
    "draw_store_rerun": build(f"""SELECT {big('chain')}, iteration, parameter, {big('idx')}, {r('value')}, model FROM dl
        WHERE model = 'view' UNION ALL SELECT {big('chain')}, iteration, parameter, {big('idx')}, {r('2 * value', 'value')}, model FROM dl
        WHERE model = 'purchase' AND chain = 1"""),
    "score_store_rerun": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'sma' AS phenotype FROM ({SCORES})
        UNION ALL SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'rd' AS phenotype FROM ({_scores('study_draws', False)})"""),
    "constancy_violations": build(" UNION ALL ".join(f"""SELECT '{rule}' AS rule, key, {big('sum(n)', 'n_rows')},
        count(*) AS n_values, min(v) AS low, max(v) AS high FROM ({rows}) GROUP BY key HAVING count(*) > 1""" for rule, rows in (
        ("population of a study", "SELECT site || ' ' || period AS key, CAST(CAST(total_population AS BIGINT) AS VARCHAR) AS v, count(*) AS n FROM pop GROUP BY ALL"),
        ("population of a site in all periods", "SELECT site AS key, CAST(CAST(total_population AS BIGINT) AS VARCHAR) AS v, count(*) AS n FROM pop GROUP BY ALL"),
        ("person-years of an age", """SELECT study_id || ' ' || coalesce(CAST(age_years AS VARCHAR), 'NA') AS key,
            CAST(CAST(n_age AS BIGINT) AS VARCHAR) AS v, count(*) AS n FROM pop_age GROUP BY ALL"""), ("detection method", "SELECT study_id AS key, detection_method AS v, count(*) AS n FROM surveys GROUP BY ALL"), ("survey size", "SELECT study_id AS key, CAST(number AS VARCHAR) AS v, count(*) AS n FROM surveys GROUP BY ALL")))),
    "score_store_roundtrip": build(f"""SELECT model, {r('d_bar')}, {r('p_d')}, {r('dic')}, 'sma' AS phenotype FROM ({SCORES})"""),
    "rate_regression": _regression("poisson", "linear"),
    "rate_regression_nb": _regression("negbin", "linear"),
    "rate_regression_logistic": _regression("poisson", "logistic"),
    "rate_regression_nb_logistic": _regression("negbin", "logistic"),
    "rate_regression_intercept": _regression("negbin", "intercept"),
    "rate_regression_rd": _regression("negbin", "linear", "f_rd"),
    "rate_regression_cm": _regression("negbin", "linear", "f_cm", "NOT (apvu IS NULL AND unconscious IS NULL AND bcs IS NULL)"),
    "rate_regression_composite": _regression("negbin", "linear", "f_c"),
    "combined_roundtrip": COMBINED,
    "sheet_roundtrip": build("SELECT " + ", ".join(
        r(c) if c in ("age_months", "temperature", "fever_days", "fits_per_24h", "hb_level")
        else big(c) if c in ("adm_month", "adm_year", "age_years", "bcs") else c for c in tb.ADMISSIONS) + " FROM adm_raw"),
    "population_parts_roundtrip": build(f"SELECT age, {r('pyor')}, file_id FROM pop_parts"),
    "survey_store_roundtrip": SURVEYS_OUT,
    "draw_store_roundtrip": build(f"""SELECT {big('chain')}, iteration, parameter, {big('idx')}, {r('value')}, model FROM dl
        WHERE model = 'purchase'"""),
}

#: Draws out of a store are the same draws.
ORACLE |= {f"{name}_stored": ORACLE[name] for name in ("expected_rates", "model_scores")}
