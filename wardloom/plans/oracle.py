"""The registered queries as plain SQL over the same tables (DuckDB dialect).

Written independently of the DataFrame code: global windows, joins on value
tables, no bucketing. Shared pieces are common table expressions.
"""

from __future__ import annotations

from wardloom.functions import lookups
from wardloom.operators.head_training import HeadSettings
from wardloom.plans.queries import ENCODING_LENGTH, ENCODING_WORDS, HEAD_STEPS, OUTCOME_SIZES, PLANTED_TOLERANCE, PLANTED_TREES, STAY_SIZES

PATIENTS = """
select c_custkey as subject_id,
       case when c_custkey % 10 = 9 then null when c_custkey % 2 = 0 then 'F' else 'M' end as gender,
       cast(18 + (c_custkey * 7) % 73 as integer) as anchor_age
from customer
"""

ADMISSIONS = """
select o_orderkey as hadm_id, case when o_orderkey % 50 = 49 then -o_custkey else o_custkey end as subject_id,
       adm as admittime,
       case when o_orderkey % 97 = 0 then null
            else adm + ((o_orderkey * 37) % 480) * interval '1' hour end as dischtime,
       case when o_orderkey % 89 = 0 then null
            when o_orderpriority = '1-URGENT' then 1 else 0 end as hospital_expire_flag,
       o_orderpriority as admission_type,
       case when o_orderkey % 11 = 0 then null else concat('WARD ', o_orderstatus) end as admission_location,
       case o_orderkey % 3 when 0 then 'Medicare' when 1 then 'Medicaid' else 'Other' end as insurance,
       case o_orderkey % 7 when 0 then null when 1 then 'SINGLE' when 2 then 'WIDOWED' else 'MARRIED' end
           as marital_status,
       case o_orderkey % 12 when 0 then null when 1 then 'BLACK/AFRICAN AMERICAN' when 2 then 'BLACK/CAPE VERDEAN'
            when 3 then 'HISPANIC OR LATINO' when 4 then 'ASIAN - CHINESE' when 5 then 'UNKNOWN'
            when 6 then 'PATIENT DECLINED TO ANSWER' when 7 then 'WHITE - BRAZILIAN' when 8 then 'OTHER'
            when 9 then 'CAUCASIAN' else 'WHITE' end as race
from (select *, o_orderdate + ((o_orderkey * 7) % 24) * interval '1' hour as adm from orders) z
"""

DIAGNOSES = """
select hadm_id, seq_num, icd_version,
       case when icd_version = 10 then
                 (case k % 4 when 0 then 'I509' when 1 then 'N179' when 2 then 'I429' else 'Q999' end)
            when k % 3 = 0 then
                 (case k % 5 when 0 then '4280' when 1 then '0389' when 2 then '486' when 3 then 'V850'
                  else '99592' end)
            when k % 31 = 1 then '25'
            when k % 37 = 2 then 'E9300'
            else cast(2400 + (k * seq_num) % 4200 as varchar) end as icd_code
from (select l_orderkey as hadm_id, l_partkey as k,
             case when l_suppkey % 3 = 0 then 10 else 9 end as icd_version,
             cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                  l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as integer) as seq_num
      from lineitem) z
"""

TIMES = """
select *, cast(epoch_us(dischtime) - epoch_us(admittime) as double) / 86400000000.0 as los_days,
       cast(hour(admittime) as integer) as admit_hour,
       cast(isodow(admittime) - 1 as integer) as admit_dayofweek,
       cast(month(admittime) as integer) as admit_month,
       case when isodow(admittime) >= 6 then 1 else 0 end as is_weekend,
       case when hour(admittime) >= 22 or hour(admittime) <= 6 then 1 else 0 end as is_night_admission
from admissions
"""

SCORED = """
select hadm_id, race, label, los_days, prob, case when prob > 0.5 then 1 else 0 end as pred,
       los_days * cast(0.5 as double) + hadm_id % 20 as los_pred
from (select hadm_id, race, coalesce(hospital_expire_flag, 0) as label,
             cast(epoch_us(dischtime) - epoch_us(admittime) as double) / 86400000000.0 as los_days,
             cast((hadm_id * 7919) % 900 + 100 * coalesce(hospital_expire_flag, 0) as double) / 1000 as prob
      from admissions) z
"""


def _values(rows) -> str:
    def cell(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _harmonized(which: str) -> str:
    rules = lookups.profile(which)
    body = "d.icd_code" if rules.chapter_keeps_whole_code else "substr(d.icd_code, 1, 3)"
    return f"""
select d.hadm_id, d.seq_num, d.icd_version, d.icd_code,
       case when d.icd_version = 10 then d.icd_code
            else coalesce(m.target, c.letter || {body}, 'UNK_' || d.icd_code) end as icd_code_harmonized
from diagnoses d
left join (values {_values(rules.code_map.items())}) m(source, target) on m.source = d.icd_code
left join (values {_values(rules.chapters)}) c(low, high, letter)
       on try_cast(substr(d.icd_code, 1, 3) as integer) between c.low and c.high
"""


def _described(which: str) -> str:
    rules = lookups.profile(which)
    exact = _values(rules.descriptions.items())
    if not rules.describe_by_group:
        return f"""
select h.*, coalesce(e.wording, 'diagnosis_' || substr(h.icd_code_harmonized, 1, 3)) as wording
from harmonized h
left join (values {exact}) e(category, wording) on starts_with(h.icd_code_harmonized, e.category)
"""
    listed = _values((i, *item) for i, item in enumerate(rules.descriptions.items()))
    return f"""
select h.*, coalesce(e.wording, g.wording, 'diagnosis code ' || h.icd_code_harmonized) as wording
from harmonized h
left join (values {exact}) e(category, wording) on starts_with(h.icd_code_harmonized, e.category)
left join (select substr(category, 1, 2) as two, arg_min(wording, place) as wording
           from (values {listed}) v(place, category, wording) group by 1) g
       on substr(h.icd_code_harmonized, 1, 2) = g.two
"""


LISTS = """
select hadm_id, string_agg(icd_code_harmonized, '|' order by seq_num) filter (where seq_num <= 10) as first_codes,
       string_agg(wording, '|' order by seq_num) filter (where seq_num <= 10) as diagnosis_wordings,
       count(seq_num) as num_diagnoses
from described group by hadm_id
"""

SHOWN = """
select hadm_id, string_agg(wording, ', ' order by first_place) as shown
from (select *, row_number() over (partition by hadm_id order by first_place) as rn
      from (select hadm_id, wording, min(seq_num) as first_place from described where seq_num <= 10
            group by hadm_id, wording) u) r
where rn <= 7 group by hadm_id
"""

MERGED = """
select t.*, p.gender, p.anchor_age, coalesce(l.first_codes, '') as first_codes,
       coalesce(l.num_diagnoses, 0) as num_diagnoses, s.shown
from times t left join lists l using (hadm_id) left join shown s using (hadm_id)
left join patients p using (subject_id)
"""


def _cohort(which: str) -> str:
    full = which == "full"
    other = "case when gender = 'M' then 'male' else 'unknown gender' end" if full else "'male'"
    extra = ", admission_type, insurance" if full else ""
    where = "" if full else "where los_days is not null"
    return f"""
select hadm_id, subject_id,
       'Patient is a ' || coalesce(cast(anchor_age as varchar), 'nan') || ' year old '
       || case when gender = 'F' then 'female' else {other} end
       || ' of ' || coalesce(lower(race), 'nan') || ' ethnicity. ' || chr(10)
       || 'Admission type: ' || coalesce(lower(admission_type), 'nan')
       || ' from ' || coalesce(lower(admission_location), 'nan') || '. ' || chr(10)
       || 'Insurance: ' || coalesce(lower(insurance), 'nan')
       || '. Marital status: ' || coalesce(lower(marital_status), 'nan') || '.' || chr(10)
       || 'Admitted on a ' || case is_weekend when 1 then 'weekend' else 'weekday' end
       || ' during ' || case is_night_admission when 1 then 'night' else 'day' end || ' hours.' || chr(10)
       || 'Number of diagnoses: ' || num_diagnoses || '.' || chr(10)
       || 'Primary diagnoses include: ' || coalesce(shown, 'no documented diagnoses') || '.' as clinical_text,
       coalesce(hospital_expire_flag, 0) as hospital_expire_flag, los_days, race, gender, anchor_age,
       num_diagnoses{extra}
from merged {where}
"""


def _split(source: str, key: str, label: str) -> str:
    """Every row ranked by hash inside its label; 30 % held out, half of it test."""
    return f"""
select * exclude (rk, n),
       case when rk <= ceil(ceil(0.3 * n) * 0.5) then 'test' when rk <= ceil(0.3 * n) then 'val' else 'train' end
           as split
from (select *, row_number() over (partition by {label} order by md5('42:' || {key})) as rk,
             count(*) over (partition by {label}) as n
      from {source}) r
"""


def _race_group(which: str) -> str:
    if which == "full":
        rows = _values(lookups.entries(lookups.RACE_GROUPS, " = ").items())
        return f"coalesce((select v.g from (values {rows}) v(r, g) where v.r = upper(race)), 'Other')"
    tests = lookups.entries(lookups.RACE_SUBSTRINGS, " = ").items()
    return "case " + " ".join(f"when upper(race) like '%{part}%' then '{g}'" for part, g in tests) + " else 'Other' end"


def _auc(source: str, groups: str = "") -> str:
    """AUC by pair counting over distinct scores."""
    keys = f"{groups}, " if groups else ""
    part = f"partition by {groups} " if groups else ""
    tail = f" group by {groups}" if groups else ""
    return f"""
select {keys}case when sum(pos) * sum(neg) > 0 then
       sum(pos * (below + neg / 2.0)) / (cast(sum(pos) as double) * sum(neg)) end as auc_roc
from (select *, coalesce(sum(neg) over ({part}order by prob rows between unbounded preceding and 1 preceding), 0)
             as below
      from (select {keys}prob, cast(sum(label) as double) as pos, cast(sum(1 - label) as double) as neg
            from {source} group by {keys}prob) a) b{tail}
"""


CELLS = """count(*) filter (where label = 1 and pred = 1) as tp, count(*) filter (where label = 0 and pred = 1) as fp,
       count(*) filter (where label = 1 and pred = 0) as fn, count(*) filter (where label = 0 and pred = 0) as tn"""

RATES = """
       coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision,
       coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
       coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0) as f1_score"""

BINARY = f"""
select auc_roc, {RATES} from (select {CELLS} from scored) c, auc
"""

REGRESSION = """
select avg(e * e) as mse, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae,
       1 - sum(e * e) / sum((los_days - m) * (los_days - m)) as r2
from (select los_days, los_pred - los_days as e, avg(los_days) over () as m
      from scored where los_days is not null) z
"""

METRIC_TABLE = """
select 'AUC-ROC' as "Metric", auc_roc as "Value" from binary_m
union all select 'Precision', precision from binary_m
union all select 'Recall', recall from binary_m
union all select 'F1-Score', f1_score from binary_m
union all select 'LOS RMSE', rmse from regression
union all select 'LOS MAE', mae from regression
union all select 'LOS R²', r2 from regression
"""


def _groups(which: str) -> str:
    least = lookups.profile(which).min_group_size
    return f"""
select race_group, n_samples, mortality_rate, auc_roc, {RATES}
from (select race_group, count(*) as n_samples, avg(cast(label as double)) as mortality_rate, {CELLS}
      from grouped where race_group <> 'Unknown' group by race_group having count(*) >= {least}) c
join group_auc using (race_group)
"""


DISPARITY = """
select count(*) as n_groups,
       case when count(auc_roc) > 1 then max(auc_roc) - min(auc_roc) end as auc_disparity,
       avg(auc_roc) as mean_auc,
       case when count(auc_roc) <= 1 then null when max(auc_roc) - min(auc_roc) > 0.1 then 'significant'
            else 'minimal' end as verdict
from fair
"""

WORDS = r"""
select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as w from documents
"""


TERMS = """
select doc_id, term from kept
union all
select doc_id, term || ' ' || following
from (select doc_id, term, lead(term) over (partition by doc_id order by place) as following from kept) b
where following is not null
"""


def _kept() -> str:
    stop = ", ".join(f"'{w}'" for w in lookups.stop_words())
    return f"""
select doc_id, term, place
from (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as place from words) a
where term not in ({stop})
"""


def _fitted(n_docs: str, where: str = "") -> str:
    return f"""
select term, n_occurrences, n_docs, ln((1.0 + ({n_docs})) / (1.0 + n_docs)) + 1.0 as idf
from (select term, sum(c) as n_occurrences, count(*) as n_docs
      from (select doc_id, term, count(*) as c from terms {where} group by doc_id, term) t group by term) v
order by n_occurrences desc, term limit {lookups.MAX_TERMS}
"""


def _weights(where: str = "") -> str:
    return f"""
select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight
from (select doc_id, term, count(*) * any_value(idf) as w from terms join vocab using (term) {where}
      group by doc_id, term) x
"""


def _layer(source: str, inputs: int, outputs: int, relu: bool) -> str:
    value = (
        f"list_sum(list_transform(range({inputs}), lambda i: x[i + 1] * (((i * 31 + j * 17) % 13 - 6) / 50.0::double)))"
        f" + ((j * 7) % 5 - 2) / 10.0::double"
    )
    value = f"greatest({value}, 0.0::double)" if relu else value
    return f"""
select vec_id, list({value} order by j) as x
from (select vec_id, x, unnest(range({outputs})) as j from {source}) u group by vec_id
"""


LAYER_INPUT = "select vec_id, list_transform(embedding, lambda v: v::double) as x from embeddings"


def _with(names: dict[str, str], final: str) -> str:
    return "with " + ",\n".join(f"{name} as ({body})" for name, body in names.items()) + "\n" + final


def _round(names: str, columns: str, source: str) -> str:
    floats = ", ".join(f"round({c}, 6) as {c}" for c in columns.split())
    plain = ", ".join(names.split())
    return "select " + ", ".join(p for p in (plain, floats) if p) + f" from {source}"


# --- heads fitted epoch by epoch: every weight is a row ---------------------------


def _materialized(names: dict[str, str], final: str) -> str:
    return "with " + ",\n".join(f"{name} as materialized ({body})" for name, body in names.items()) + "\n" + final


def _first_weights(inputs: int, outputs: int) -> str:
    """Input number ``inputs`` is the constant, so its weight is the bias."""
    return f"""
select cast(j as integer) as j, cast(i as integer) as i, 0.0::double as m, 0.0::double as v,
       case when i < {inputs} then ((i * 31 + j * 17) % 13 - 6) / 50.0::double else ((j * 7) % 5 - 2) / 10.0::double end as w
from range({inputs + 1}) r(i), range({outputs}) s(j)"""


def _fitted_head(sizes: tuple[int, ...], label: str, classes: bool, settings: HeadSettings) -> dict[str, str]:
    """Tables o_t (vec_id, z: outputs after t steps), l_t (losses) and s_t for every step."""
    layers = range(len(sizes) - 1)
    last = len(sizes) - 2
    sql = {
        "placed": _split("(select vec_id, label, embedding from embeddings) e", "vec_id", "label"),
        "known": f"select vec_id, split, {label} as y, list_append(list_transform(embedding, lambda c: c::double), 1.0::double) as a from placed",
        "n_train": "select count(*) as n from known where split = 'train'",
    }
    sql |= {f"w{k}_0": _first_weights(sizes[k], sizes[k + 1]) for k in layers}
    for t in range(settings.epochs + 1):
        for k in layers:
            before = "known" if not k else f"a{k}_{t}"
            sql[f"z{k}_{t}"] = f"""
                select vec_id, j, list_dot_product(a, u.w) as z
                from {before}, (select j, list(w order by i) as w from w{k}_{t} group by j) u"""
            if k < last:
                sql[f"a{k + 1}_{t}"] = f"""
                    select vec_id, list_append(list(greatest(z, 0.0::double) order by j), 1.0::double) as a from z{k}_{t} group by vec_id"""
        sql[f"o_{t}"] = f"select vec_id, split, y, list(z order by j) as z from z{last}_{t} join known using (vec_id) group by all"
        if classes:
            gap = "(z[2] - z[1])"
            own = f"case when y = 1 then -{gap} else {gap} end"
            sql[f"l_{t}"] = f"""
                select vec_id, split, y, 1 / (1 + exp(-{gap})) as prob, case when {gap} > 0 then 1 else 0 end as pred,
                       ln(1 + exp({own})) as loss, 0.0::double as size from o_{t}"""
            slope = f"case j when 1 then 1 else -1 end * (1 / (1 + exp(-{gap})) - y)"
        else:
            sql[f"l_{t}"] = f"select vec_id, split, y, z[1] as los_pred, (z[1] - y) * (z[1] - y) as loss, abs(z[1] - y) as size from o_{t}"
            slope = "2 * (z[1] - y)"
        if t == settings.epochs:
            break
        sql[f"d{last}_{t}"] = f"select vec_id, cast(j as integer) as j, {slope} as d from o_{t}, range({sizes[-1]}) r(j) where split = 'train'"
        for k in reversed(layers):
            before = "known" if not k else f"a{k}_{t}"
            sql[f"g{k}_{t}"] = f"""
                select j, cast(i as integer) as i, list_dot_product(x, d) / (select n from n_train) as g
                from (select i, list(c order by vec_id) as x
                      from (select vec_id, unnest(a) as c, generate_subscripts(a, 1) - 1 as i from {before}
                            where vec_id in (select vec_id from known where split = 'train')) u group by i) columns_of_a,
                     (select j, list(d order by vec_id) as d from d{k}_{t} group by j) columns_of_d"""
            if k:
                sql[f"d{k - 1}_{t}"] = f"""
                    select b.vec_id, b.j, case when b.z > 0 then list_dot_product(r.d, u.w) else 0.0::double end as d
                    from z{k - 1}_{t} b
                    join (select vec_id, list(d order by j) as d from d{k}_{t} group by vec_id) r using (vec_id)
                    join (select i, list(w order by j) as w from w{k}_{t} group by i) u on u.i = b.j"""
        norms = " union all ".join(f"select sum(g * g) as q from g{k}_{t}" for k in layers)
        sql[f"c_{t}"] = f"select least(1.0::double, {settings.clip}::double / (sqrt(sum(q)) + 1e-6::double)) as c from ({norms}) q"
        rate = settings.rate_at(t)
        for k in layers:
            m, v = "0.9::double * m + 0.1::double * (g * c)", "0.999::double * v + 0.001::double * (g * c) * (g * c)"
            sql[f"w{k}_{t + 1}"] = f"""
                select j, i, m, v, w * (1 - {rate!r}::double * {settings.decay!r}::double)
                       - {rate!r}::double * (m / (1 - pow(0.9::double, {t + 1}))) / (sqrt(v / (1 - pow(0.999::double, {t + 1}))) + 1e-8::double) as w
                from (select j, i, w, {m} as m, {v} as v from w{k}_{t} join g{k}_{t} using (j, i), c_{t}) s"""
    steps = range(1, settings.epochs + 1)
    sql["after"] = " union all ".join(f"select {t} as iteration, * from l_{t}" for t in steps)
    sql["fitted"] = " union all ".join(f"select {t} as iteration, avg(loss) as train_loss from l_{t - 1} where split = 'train'" for t in steps)
    if classes:
        sql["held"] = "select iteration, prob, y as label from after where split = 'val'"
        sql["measured"] = f"select iteration, auc_roc as val_auc, -auc_roc as rank from ({_auc('held', 'iteration')}) q"
    else:
        sql["measured"] = "select iteration, avg(size) as val_mae, avg(loss) as rank from after where split = 'val' group by iteration"
    sql["best"] = "select iteration as kept from measured order by rank, iteration limit 1"
    return sql


def _head_history(measure: str) -> str:
    return f"""
select cast(f.iteration as integer) as iteration, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss,
       round({measure}, 6) as {measure}, f.iteration = (select kept from best) as kept
from fitted f join measured m on m.iteration = f.iteration
join (select iteration, avg(loss) as val_loss from after where split = 'val' group by iteration) v on v.iteration = f.iteration"""


# --- boosting on an outcome that one split tells apart -----------------------------


def _margins(trees: int) -> str:
    """Margin (of either sign) after each tree: all rows of a class have the same, so every tree adds the same to it."""
    return f"""
select 1 as iteration, 1.0::double as f
union all select iteration + 1, f + {lookups.BOOSTING_RATE}::double * 4 / (1 + exp(2 * f)) from margins where iteration < {trees}"""


def _recursive(names: dict[str, str], final: str) -> str:
    return _with(names, final).replace("with ", "with recursive ", 1)


def oracle_sql() -> dict[str, str]:
    base = {"patients": PATIENTS, "admissions": ADMISSIONS, "diagnoses": DIAGNOSES}
    scored = {"admissions": ADMISSIONS, "scored": SCORED}

    def coded(which: str) -> dict[str, str]:
        return {"diagnoses": DIAGNOSES, "harmonized": _harmonized(which), "described": _described(which)}

    def whole(which: str) -> dict[str, str]:
        return base | coded(which) | {
            "times": TIMES, "lists": LISTS, "shown": SHOWN, "merged": MERGED, "cohort": _cohort(which)
        }

    def fair(which: str) -> dict[str, str]:
        return scored | {
            "grouped": f"select *, {_race_group(which)} as race_group from scored",
            "group_auc": _auc("grouped", "race_group"),
            "fair": _groups(which),
        }

    stamped = """select hadm_id, subject_id, strftime(admittime, '%Y-%m-%d %H:%M:%S') as admittime,
        strftime(dischtime, '%Y-%m-%d %H:%M:%S') as dischtime, hospital_expire_flag, admission_type,
        admission_location, insurance, marital_status, race"""
    labelled = {
        "admissions": ADMISSIONS,
        "labelled": "select hadm_id, subject_id, coalesce(hospital_expire_flag, 0) as hospital_expire_flag"
                    " from admissions",
    }
    placed = labelled | {"placed": _split("labelled", "hadm_id", "hospital_expire_flag")}
    outcome = scored | {"auc": _auc("scored"), "binary_m": BINARY}
    both = outcome | {"regression": REGRESSION}
    rates = "auc_roc precision recall f1_score"
    fair_columns = "mortality_rate auc_roc precision recall f1_score"
    text = {"words": WORDS, "kept": _kept(), "terms": TERMS}
    docs_split = {"placed": _split("(select doc_id, lang from documents) d", "doc_id", "lang")}
    train = "where doc_id in (select doc_id from placed where split = 'train')"
    sql: dict[str, str] = {}

    sql["scan_patients"] = PATIENTS
    sql["scan_admissions"] = _with({"admissions": ADMISSIONS}, f"{stamped} from admissions")
    sql["scan_diagnoses"] = DIAGNOSES
    for name in ("load_csv_patients", "load_csv_gaps"):
        sql[name] = f"select subject_id as _row_id, * from ({PATIENTS}) p"
    sql["load_csv_sizes"] = _with(base, """select 'patients' as table_name, count(*) as n_rows from patients
        union all select 'admissions', count(*) from admissions
        union all select 'diagnoses', count(*) from diagnoses""")
    sql["load_csv_admissions"] = _with(
        {"admissions": ADMISSIONS}, f"{stamped}, hadm_id as _row_id from admissions"
    )
    sql["load_csv_diagnoses"] = _with(
        {"diagnoses": DIAGNOSES}, "select *, hadm_id * 1000000 + seq_num as _row_id from diagnoses"
    )
    for which in ("full", "compact"):
        sql[f"harmonize_{which}"] = _with(coded(which), "select * from harmonized")
        sql[f"describe_{which}"] = _with(
            coded(which), "select hadm_id, seq_num, icd_code_harmonized, wording from described"
        )
        sql[f"cohort_{which}"] = _with(
            whole(which),
            "select * replace (round(los_days, 6) as los_days) from cohort",
        )
        sql[f"clinical_text_{which}"] = _with(
            whole(which), _round("hadm_id hospital_expire_flag clinical_text", "los_days", "cohort")
        )
        sql["race_group_" + ("exact" if which == "full" else "substring")] = _with(
            {"admissions": ADMISSIONS}, f"select hadm_id, race, {_race_group(which)} as race_group from admissions"
        )
        sql[f"fairness_{which}"] = _with(fair(which), _round("race_group n_samples", fair_columns, "fair"))
    sql["diagnosis_summaries"] = _with(coded("full") | {"lists": LISTS}, "select * from lists")
    for name, part_size in (("diagnosis_lists", 10_000), ("diagnosis_list_parts", 2)):
        sql[name] = _with(coded("full"), f"""
            select hadm_id, cast((seq_num - 1) // {part_size} as integer) as part,
                   string_agg(icd_code_harmonized, '|' order by seq_num) as diagnosis_codes,
                   count(seq_num) as num_diagnoses
            from harmonized group by 1, 2""")
    # model output cannot be told in SQL; its rows, keys, labels and ranges can
    cohort_split = whole("compact") | {"placed": _split("cohort", "hadm_id", "hospital_expire_flag")}
    sql["gbt_mortality"] = _with(cohort_split, """
        select hadm_id, hospital_expire_flag, true as prob_in_range, true as pred_agrees from placed where split = 'test'""")
    sql["gbt_los"] = _with(cohort_split, """
        select hadm_id, round(los_days, 6) as los_days, true as los_pred_finite from placed where split = 'test'""")
    for name, series in (("training_history", "train_loss val_loss val_auc"), ("los_history", "train_loss val_loss val_mae")):
        listed = ", ".join(f"('{x}')" for x in series.split())
        sql[name] = f"""
            select cast(i as integer) as iteration, series, true as value_finite
            from range(1, {lookups.BOOSTING_TREES + 1}) r(i) cross join (values {listed}) v(series)"""
    heads = {"placed": _split("(select vec_id, label from embeddings) e", "vec_id", "label")}
    sql["fit_vector_head"] = _with(heads, """
        select vec_id, label, true as pred_is_a_label, true as prob_in_range from placed where split = 'test'""")
    sql["fit_vector_regressor"] = _with(heads, "select vec_id, label, true as pred_finite from placed where split = 'test'")
    features = "admit_hour admit_dayofweek admit_month is_weekend is_night_admission"
    sql["time_features"] = _with(
        {"admissions": ADMISSIONS, "times": TIMES}, _round(f"hadm_id {features}", "los_days", "times")
    )
    sql["event_time_features"] = """
        select event_id, cast(hour(ts) as integer) as admit_hour, cast(isodow(ts) - 1 as integer) as admit_dayofweek,
               cast(month(ts) as integer) as admit_month, case when isodow(ts) in (6, 7) then 1 else 0 end as is_weekend,
               case when hour(ts) >= 22 or hour(ts) <= 6 then 1 else 0 end as is_night_admission
        from events"""
    sql["merged_cohort"] = _with(
        whole("full"),
        f"{stamped}, gender, anchor_age, round(los_days, 6) as los_days, {', '.join(features.split())},"
        " first_codes, num_diagnoses from merged",
    )
    sql["example_paragraph"] = _with(
        whole("full"),
        _round("hadm_id hospital_expire_flag clinical_text", "los_days", "cohort") + " order by hadm_id limit 1",
    )
    sql["cohort_profile"] = _with(
        {"admissions": ADMISSIONS, "times": TIMES},
        "select count(*) as n_admissions, round(avg(hospital_expire_flag) * 100, 6) as mortality_percent,"
        " round(avg(los_days), 6) as mean_los_days from times",
    )
    sql["stratified_split"] = _with(placed, "select * from placed")
    sql["patient_split"] = _with(
        labelled
        | {"people": "select subject_id, max(hospital_expire_flag) as flag from labelled group by subject_id",
           "placed": _split("people", "subject_id", "flag")},
        "select l.*, p.split from labelled l join placed p using (subject_id)",
    )
    sql["split_profile"] = _with(
        placed,
        "select split, count(*) as n_rows, round(avg(hospital_expire_flag) * 100, 6) as label_percent"
        " from placed group by split",
    )
    sql["label_split"] = _split("(select doc_id, quality from labels) q", "doc_id", "quality")

    sql["roc_auc"] = _with(outcome, _round("", "auc_roc", "auc"))
    sql["binary_metrics"] = _with(outcome, _round("", rates, "binary_m"))
    grid = "(values (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)"
    sql["confusion"] = _with(scored, f"""
        select g.actual, g.predicted, count(s.hadm_id) as n
        from {grid} left join scored s on s.label = g.actual and s.pred = g.predicted group by 1, 2""")
    sql["confusion_chart"] = _with(scored, f"""
        select case g.actual when 0 then 'Survived' else 'Expired' end as actual,
               case g.predicted when 0 then 'Survived' else 'Expired' end as predicted, count(s.hadm_id) as n
        from {grid} left join scored s on s.label = g.actual and s.pred = g.predicted group by 1, 2""")
    def report(source: str, label: str, pred: str, names: tuple[str, str]) -> dict[str, str]:
        return {
            "per_class": f"""
            select c, count(*) filter (where {pred} = c and {label} = c) as hit,
                   count(*) filter (where {pred} = c) as claimed, count(*) filter (where {label} = c) as support
            from {source}, (values (0), (1)) k(c) group by c""",
            "rates": f"""
            select case c when 0 then '{names[0]}' else '{names[1]}' end as class,
                   coalesce(hit / nullif(cast(claimed as double), 0), 0) as precision,
                   coalesce(hit / nullif(cast(support as double), 0), 0) as recall,
                   coalesce(2 * hit / nullif(cast(claimed + support as double), 0), 0) as f1_score, support, hit
            from per_class""",
            "report": """
            select class, precision, recall, f1_score, support from rates
            union all select 'accuracy', null, null, sum(hit) / cast(sum(support) as double), sum(support) from rates
            union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) from rates
            union all select 'weighted avg', sum(precision * support) / sum(support),
                      sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support)
                      from rates""",
        }

    report_rows = (
        "select class, round(precision, 6) as precision, round(recall, 6) as recall,"
        " round(f1_score, 6) as f1_score, cast(support as bigint) as support from report"
    )
    sql["class_report"] = _with(scored | report("scored", "label", "pred", lookups.OUTCOME_NAMES), report_rows)
    sql["label_report"] = _with(report("labels", "quality", "toxic", ("low", "high")), report_rows)
    sql["log_loss"] = _with(scored, """
        select round(avg(-ln(least(greatest(case label when 1 then prob else 1 - prob end, 1e-15), 1 - 1e-15))), 6)
               as log_loss from scored""")
    sql["regression_metrics"] = _with(
        scored | {"regression": REGRESSION}, _round("", "mse rmse mae r2", "regression")
    )
    table = _with(both | {"metric_rows": METRIC_TABLE},
                  'select "Metric", round("Value", 6) as "Value" from metric_rows')
    sql["metric_table"] = table
    sql["write_metrics_roundtrip"] = table
    sql["write_groups_roundtrip"] = sql["fairness_compact"]
    sql["fairness_first_seen"] = sql["fairness_full"]
    sql["fairness_disparity"] = _with(
        fair("full") | {"spread": DISPARITY}, _round("n_groups verdict", "auc_disparity mean_auc", "spread")
    )
    sql["group_metric_long"] = _with(
        fair("full") | {"long": """
            select race_group, 'auc_roc' as metric, auc_roc as value from fair
            union all select race_group, 'precision', precision from fair
            union all select race_group, 'recall', recall from fair
            union all select race_group, 'f1_score', f1_score from fair"""},
        "select race_group, metric, round(value, 6) as value,"
        " round(avg(value) over (partition by metric), 6) as mean_over_groups from long where value is not null",
    )
    sql["residual_histogram"] = _with(
        scored
        | {"errors": "select los_pred - los_days as e from scored where los_days is not null",
           "ends": "select min(e) as low, max(e) as high, (max(e) - min(e)) / 50 as width from errors",
           "binned": "select least(cast(floor((e - low) / width) as integer), 49) as bin from errors, ends"},
        """select cast(b.bin as integer) as bin, round(low + b.bin * width, 6) as low,
                  round(low + (b.bin + 1) * width, 6) as high,
                  (select count(*) from binned x where x.bin = b.bin) as n
           from range(50) b(bin), ends""",
    )
    sql["pred_actual_density"] = _with(
        scored
        | {"pairs": "select los_days as y, los_pred as p from scored where los_days is not null",
           "top": "select greatest(max(y), max(p)) as axis_max from pairs"},
        """select least(cast(floor(y / (axis_max / 50)) as integer), 49) as actual_bin,
                  least(cast(floor(p / (axis_max / 50)) as integer), 49) as predicted_bin,
                  round(axis_max, 6) as axis_max, count(*) as n
           from pairs, top group by 1, 2, axis_max""",
    )
    sql["run_summary"] = _with(
        fair("full") | {"auc": _auc("scored"), "binary_m": BINARY, "regression": REGRESSION, "spread": DISPARITY},
        _round("n_groups verdict", f"{rates} mse rmse mae r2 auc_disparity", "binary_m, regression, spread"),
    )
    rounds = scored | {"rounds": "select *, cast(hadm_id % 20 + 1 as integer) as iteration from scored",
                       "round_auc": _auc("rounds", "iteration")}
    sql["round_history"] = _with(rounds, """
        select iteration, 'val_auc' as series, round(auc_roc, 6) as value from round_auc
        union all
        select iteration, 'val_loss',
               round(avg(-ln(least(greatest(case label when 1 then prob else 1 - prob end, 1e-15), 1 - 1e-15))), 6)
        from rounds group by iteration""")
    sql["best_iteration"] = _with(rounds, """
        select iteration as best_iteration, value as best_value
        from (select iteration, round(auc_roc, 6) as value from round_auc) r
        order by value desc, iteration limit 1""")

    sql["tokens"] = _with({"words": WORDS}, """
        select term, cast(sum(c) as bigint) as n_occurrences, count(*) as n_docs
        from (select doc_id, term, count(*) as c from (select doc_id, unnest(w) as term from words) u
              group by doc_id, term) t
        group by term""")
    fitted = text | {"vocab": _fitted("select count(*) from documents")}
    sql["vocabulary"] = _with(
        fitted, "select term, cast(n_occurrences as bigint) as n_occurrences, n_docs from vocab"
    )
    sql["vocabulary_by_sketch"] = sql["vocabulary"]
    sql["tfidf"] = _with(fitted, _weights())
    sql["tfidf_holdout"] = _with(
        docs_split | text
        | {"vocab": _fitted("select count(*) from placed where split = 'train'", train)},
        _weights("where doc_id in (select doc_id from placed where split = 'test')"),
    )
    room = ENCODING_LENGTH - 2
    sql["encode_fixed_length"] = _with(
        {"words": WORDS,
         "flat": "select doc_id, unnest(w) as term, generate_subscripts(w, 1) as place from words",
         "ids": f"""select term, row_number() over (order by c desc, term) + 3 as id
                    from (select term, count(*) as c from flat group by term) t
                    order by c desc, term limit {ENCODING_WORDS}""",
         "body": f"""select doc_id, list(coalesce(id, 1) order by place) as b
                     from flat left join ids using (term) where place <= {room} group by doc_id""",
         "framed": """select doc_id, list_concat(list_concat([2], coalesce(b, [])), [3]) as f
                      from documents left join body using (doc_id)"""},
        f"""select doc_id,
                   array_to_string(list_resize(f, {ENCODING_LENGTH}, 0), '|') as input_ids,
                   array_to_string(list_resize(list_transform(f, lambda v: 1), {ENCODING_LENGTH}, 0), '|')
                       as attention_mask
            from framed""",
    )
    sql["softmax_argmax"] = """
        select vec_id, round(w[2] / total, 6) as prob, round(list_max(w) / total, 6) as top_prob,
               cast(list_position(e, list_max(e)) - 1 as integer) as pred
        from (select vec_id, e, w, list_sum(w) as total
              from (select vec_id, embedding as e,
                           list_transform(embedding, lambda v: exp(v::double - list_max(embedding)::double)) as w
                    from embeddings) a) b"""
    sql["first_vector"] = """
        select vec_id, cast(p as integer) as place, round(embedding[p + 1]::double, 6) as value
        from embeddings, range(8) r(p)"""
    sql["score_head"] = _with(
        {"a": LAYER_INPUT, "b": _layer("a", 64, 256, True), "c": _layer("b", 256, 2, False)},
        "select vec_id, round(exp(x[2] - list_max(x)) / (exp(x[1] - list_max(x)) + exp(x[2] - list_max(x))), 6)"
        " as prob, case when x[2] > x[1] then 1 else 0 end as pred from c",
    )
    sql["score_head_los"] = _with(
        {"a": LAYER_INPUT, "b": _layer("a", 64, 256, True), "c": _layer("b", 256, 64, True),
         "d": _layer("c", 64, 1, False)},
        "select vec_id, round(x[1], 6) as los_pred from d",
    )

    outcome_head = _fitted_head(OUTCOME_SIZES, "case when embedding[1]::double + embedding[2]::double > 0 then 1 else 0 end", True, HEAD_STEPS)
    stay_head = _fitted_head(STAY_SIZES, "5.0::double + 4.0::double * embedding[1]::double - 2.0::double * embedding[2]::double", False, HEAD_STEPS)
    chosen = "from after where split = 'test' and iteration = (select kept from best)"
    sql["head_history"] = _materialized(outcome_head, _head_history("val_auc"))
    sql["regressor_history"] = _materialized(stay_head, _head_history("val_mae"))
    sql["head_best_scores"] = _materialized(outcome_head, f"select vec_id, cast(y as integer) as high, round(prob, 6) as prob, pred {chosen}")
    sql["regressor_best_scores"] = _materialized(stay_head, f"select vec_id, round(y, 6) as stay, round(los_pred, 6) as los_pred {chosen}")

    # the study: the admission type decides outcome and stay, so the first split of a tree tells them apart
    def study(which: str, trees: int) -> dict[str, str]:
        names = {
            "patients": PATIENTS, "diagnoses": DIAGNOSES, "raw_admissions": ADMISSIONS,
            "admissions": """
                select * replace (case when admission_type = '1-URGENT' then 1 else 0 end as hospital_expire_flag,
                                  case when dischtime is not null then
                                       admittime + (case when admission_type = '1-URGENT' then 120 else 48 end) * interval '1' hour end as dischtime)
                from raw_admissions""",
        }
        names |= {k: v for k, v in whole(which).items() if k not in names}
        margin = "(select f from margins order by iteration desc limit 1)"
        return names | {
            "placed": _split("cohort", "hadm_id", "hospital_expire_flag"),
            "margins": _margins(trees),
            "rescored": f"""
                select hadm_id, race, hospital_expire_flag as label, los_days, 1 / (1 + exp(-2 * {margin} * (2 * hospital_expire_flag - 1))) as prob,
                       hospital_expire_flag as pred, 2.0::double + 3 * hospital_expire_flag as los_pred, split
                from placed""",
            "scored": "select * from rescored where split = 'test'",
        }

    def study_report(which: str, trees: int, place: str) -> str:
        names = study(which, trees) | {
            "grouped": f"select *, {_race_group(which)} as race_group from scored",
            "group_auc": _auc("grouped", "race_group"), "fair": _groups(which),
            "auc": _auc("scored"), "binary_m": BINARY, "regression": REGRESSION, "metric_rows": METRIC_TABLE,
            "first_rows": "select race_group, min(hadm_id) as first_row from grouped group by race_group",
            "ranked": f"select f.*, cast(row_number() over (order by {place}, race_group) as integer) as place from fair f join first_rows using (race_group)",
        }
        measures = "n_samples mortality_rate auc_roc precision recall f1_score".split()
        parts = ["""select 'metrics' as section, cast(null as integer) as place, 'all' as name, "Metric" as metric, round("Value", 6) as value from metric_rows"""]
        parts += [f"select 'fairness', place, race_group, '{m}', round(cast({m} as double), 6) from ranked" for m in measures]
        for m, value in (("n_rows", "count(*)"), ("label_percent", "avg(hospital_expire_flag) * 100")):
            parts.append(f"select 'splits', null, split, '{m}', round(cast({value} as double), 6) from placed group by split")
        return _recursive(names, " union all ".join(parts))

    sql["study_compact"] = study_report("compact", 5, "n_samples desc")
    sql["study_full"] = study_report("full", 1, "first_row")
    sql["study_rescored"] = _recursive(study("compact", 5), "select hadm_id, round(prob, 6) as prob, pred, round(los_pred, 6) as los_pred from rescored")
    ranked = lambda order, source="fair": f"select cast(row_number() over (order by {order}, race_group) as integer) as place, race_group, n_samples from {source}"
    sql["group_places_by_size"] = _with(fair("compact"), ranked("n_samples desc"))
    sql["write_group_places_roundtrip"] = sql["group_places_by_size"]
    sql["group_places_by_first_seen"] = _with(
        fair("full") | {"first_rows": "select race_group, min(hadm_id) as first_row from grouped group by race_group"},
        ranked("first_row", "fair join first_rows using (race_group)"))

    sql["group_places_in_files"] = _with(
        fair("full") | {"first_rows": "select race_group, max(hadm_id) as last_row from grouped group by race_group"},
        ranked("last_row desc", "fair join first_rows using (race_group)"))
    sql["file_order"] = _with({"admissions": ADMISSIONS}, "select hadm_id, race, row_number() over (order by hadm_id desc) - 1 as line from admissions")
    sql["load_csv_rejects"] = _with({"admissions": ADMISSIONS}, """
        select hadm_id as row_label, 'admittime' as column_name, 'last Tuesday' as text from admissions where hadm_id % 13 = 0
        union all select hadm_id, 'hospital_expire_flag', 'yes' from admissions where hadm_id % 17 = 0""")
    sql["load_csv_lenient"] = _with({"admissions": ADMISSIONS}, """
        select hadm_id, case when hadm_id % 13 <> 0 then strftime(admittime, '%Y-%m-%d %H:%M:%S') end as admittime,
               strftime(dischtime, '%Y-%m-%d %H:%M:%S') as dischtime,
               case when hadm_id % 17 <> 0 then hospital_expire_flag end as hospital_expire_flag, race
        from admissions""")
    unplaced = {"raw_admissions": ADMISSIONS, "admissions": "select * replace ('unknown' as admission_location) from raw_admissions"}
    unplaced |= {k: v for k, v in whole("full").items() if k not in unplaced}
    sql["text_missing_column"] = _with(unplaced, "select hadm_id, clinical_text from cohort")

    has = lambda word: f"case when contains(clinical_text, '{word}') then 1 else 0 end"
    planted = whole("compact") | {
        "given": f"select hadm_id, {has('pneumonia')} as outcome, 2.0::double + 3 * {has('sepsis')} + 1.5::double * {has('pneumonia')} as stay from cohort",
        "placed": _split("given", "hadm_id", "outcome"),
        "margins": _margins(6 * PLANTED_TREES),
    }
    prob = "round(1 / (1 + exp(-2 * f * (2 * outcome - 1))), 6) as prob, outcome as pred"
    sql["gbt_planted_outcome"] = _recursive(
        planted, f"select hadm_id, outcome, {prob} from placed, margins where split = 'test' and iteration = {PLANTED_TREES}")
    sql["gbt_planted_stay"] = _recursive(
        planted, "select hadm_id, round(stay, 6) as stay, round(stay, 6) as los_pred from placed where split = 'test'")
    sql["planted_history"] = _recursive({"margins": _margins(PLANTED_TREES)}, """
        select cast(iteration as integer) as iteration, series, round(case when series = 'val_auc' then 1 else ln(1 + exp(-2 * f)) end, 6) as value
        from margins, (values ('train_loss'), ('val_loss'), ('val_auc')) v(series)""")
    # the error after a tree is 2 ln(1 + exp(-2 f)); the first tree that lowers it too little is the one after the last kept
    sql["best_iteration_scores"] = _recursive(planted | {
        "errors": "select iteration, f, 2 * ln(1 + exp(-2 * f)) as error from margins",
        "stop": f"""select coalesce(min(b.iteration), {6 * PLANTED_TREES} + 1) - 1 as last from errors a join errors b on b.iteration = a.iteration + 1
                    where a.error - b.error < {PLANTED_TOLERANCE} * greatest(b.error, 0.01)"""},
        f"select hadm_id, outcome, {prob}, cast(iteration as integer) as trees from placed, margins, stop where split = 'test' and iteration = last")
    return sql
