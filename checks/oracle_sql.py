"""The registered queries as DuckDB SQL over the same tables.

Written from the definitions, not from the Spark plans: windows and range joins over whole
groups where Spark uses blocks, splits and buckets.
"""

from __future__ import annotations

from censemble.functions import fixed
from censemble.operators.prompts import _pieces
from censemble.plans import catalog as cat
from censemble.plans import fixtures as fx
from censemble.plans.catalog import ANSWERS, BRIEFING_TEMPLATE, CAP_USD, MISSING, VERSIONS


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _pick(items: list, index: str) -> str:
    """0-based pick from a literal list."""
    cells = ", ".join(_text(i) if isinstance(i, str) or i is None else str(i) for i in items)
    return f"([{cells}])[({index}) + 1]"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(c) if isinstance(c, str) else str(c) for c in r) + ")" for r in rows)


def _digest(*parts: str) -> str:
    return "md5(" + " || ':' || ".join(f"({p})::VARCHAR" for p in parts) + ")"


def _hash(*parts: str) -> str:
    return f"('0x' || substr({_digest(*parts)}, 1, 15))::BIGINT"


def _unit(*parts: str) -> str:
    return f"(('0x' || substr({_digest(*parts)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _json_text(versions: dict[str, str]) -> str:
    return "{" + ", ".join(f'"{k}": "{versions[k]}"' for k in sorted(versions)) + "}"


AGE = "CASE WHEN {0} < 18 THEN NULL WHEN {0} <= 29 THEN '18-29' WHEN {0} <= 44 THEN '30-44' WHEN {0} <= 64 THEN '45-64' WHEN {0} IS NOT NULL THEN '65+' END"
VALUES4 = ["p_climate_action_support", "p_gun_restriction_support", "p_tax_on_rich_support", "ideology_score"]
SKELETON = "state, puma, age_band, sex, race_eth, education, income_band"
_other_races = [r for r in fixed.RACES if r != "asian_nh"]

CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


_cte("states", [], f"SELECT * FROM (VALUES {_values([(c, s) for c, s in fixed.FIPS_STATES.items()])}) t(fips, state)")
_cte("microdata", [], f"""
    SELECT {_pick(fx.NATION_FIPS, 's_nationkey')}::INTEGER AS ST,
           CASE WHEN l_suppkey % 50 <> 0 THEN 200 + l_suppkey END AS PUMA10,
           CASE WHEN l_suppkey % 10 = 0 THEN -9 ELSE 100 + l_suppkey END AS PUMA20,
           l_partkey % 95 AS AGEP, 1 + l_linenumber % 2 AS SEX, 1 + l_partkey % 9 AS RAC1P,
           CASE WHEN l_orderkey % 6 = 0 THEN 2 ELSE 1 END AS HISP,
           CASE WHEN l_orderkey % 97 <> 0 THEN 1 + l_orderkey % 24 END AS SCHL,
           CASE WHEN l_partkey % 89 <> 0 THEN l_extendedprice * 2 END AS PINCP,
           l_quantity::INTEGER AS PWGTP
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
_cte("recoded", ["microdata", "states"], f"""
    SELECT * FROM (
      SELECT s.state,
             lpad(coalesce(CASE WHEN PUMA20 NOT IN (-9, 0) THEN PUMA20 END,
                           CASE WHEN PUMA10 NOT IN (-9, 0) THEN PUMA10 END)::VARCHAR, 5, '0') AS puma,
             {AGE.format('AGEP')} AS age_band,
             CASE WHEN SEX = 1 THEN 'male' ELSE 'female' END AS sex,
             CASE WHEN HISP <> 1 THEN 'hispanic' WHEN RAC1P = 1 THEN 'white_nh' WHEN RAC1P = 2 THEN 'black_nh'
                  WHEN RAC1P = 6 THEN 'asian_nh' ELSE 'other_nh' END AS race_eth,
             CASE WHEN SCHL <= 15 THEN 'lt_hs' WHEN SCHL <= 17 THEN 'hs' WHEN SCHL <= 20 THEN 'some_college'
                  WHEN SCHL = 21 THEN 'bachelors' ELSE 'graduate' END AS education,
             CASE WHEN coalesce(PINCP, 0) < 25000 THEN 'lt_25k' WHEN PINCP < 50000 THEN '25_50k'
                  WHEN PINCP < 75000 THEN '50_75k' WHEN PINCP < 125000 THEN '75_125k' ELSE '125k_plus' END AS income_band,
             PWGTP::BIGINT AS PWGTP
      FROM microdata m JOIN states s ON m.ST = s.fips
      WHERE AGEP IS NOT NULL AND SEX IS NOT NULL AND RAC1P IS NOT NULL AND HISP IS NOT NULL AND SCHL IS NOT NULL)
    WHERE puma IS NOT NULL AND age_band IS NOT NULL""")
_cte("cells", ["recoded"], f"""
    SELECT {SKELETON}, sum(PWGTP)::BIGINT AS person_weight, count(PWGTP) AS record_count
    FROM recoded GROUP BY ALL""")
_cte("pool", ["cells"], "SELECT * FROM cells WHERE record_count >= 5")

_school = "CASE WHEN o_orderkey % 100 = 0 THEN 'lt_hs' WHEN o_orderkey % 100 < 40 THEN 'hs' WHEN o_orderkey % 100 < 70 THEN 'some_college' WHEN o_orderkey % 100 < 90 THEN 'bachelors' WHEN o_orderkey % 100 < 98 THEN 'graduate' END"
_cte("coded", [], f"""
    SELECT * FROM (
      SELECT CASE WHEN o_custkey % 9 BETWEEN 1 AND 3 THEN 'dem' WHEN o_custkey % 9 = 4 THEN 'ind'
                  WHEN o_custkey % 9 BETWEEN 5 AND 7 THEN 'rep' END AS party_id,
             {_school} AS education,
             {AGE.format('(15 + (o_custkey * 7) % 75)')} AS age_band,
             CASE WHEN o_custkey % 100 < 60 THEN 'white_nh' WHEN o_custkey % 100 < 75 THEN 'black_nh'
                  WHEN o_custkey % 100 < 90 THEN 'hispanic' WHEN o_custkey % 100 < 97 THEN 'asian_nh'
                  WHEN o_custkey % 100 < 99 THEN 'other_nh' END AS race_eth,
             CASE (o_orderkey // 3) % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS climate,
             CASE (o_custkey // 5) % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS guns,
             CASE (o_orderkey // 11) % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS taxes,
             CASE WHEN (o_custkey // 3) % 9 BETWEEN 1 AND 7 THEN (o_custkey // 3) % 9 - 4 END AS ideology_units
      FROM orders)
    WHERE party_id IS NOT NULL AND education IS NOT NULL AND age_band IS NOT NULL""")


def _label_case(mapping: dict, value: str) -> str:
    return "CASE " + value + " " + " ".join(
        f"WHEN {_text(k)} THEN {_text(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + " END"


_cte("survey_labels", [], f"""
    SELECT {_pick(fx.PARTY_ANSWERS, 'o_custkey % 9')} AS pid7, {_pick(fx.EDUCATION_ANSWERS, 'o_orderkey % 7')} AS educ,
           CASE WHEN o_orderkey % 61 = 0 THEN 'n/a' ELSE (1930 + o_custkey % 80)::VARCHAR END AS birthyr,
           {_pick(fx.IDEOLOGY_ANSWERS, '(o_custkey // 3) % 7')} AS ideo5,
           {_pick(['Support', 'Oppose', 'Not sure', None], '(o_orderkey // 3) % 4')} AS climate_answer,
           {_pick(['For', 'Against', 'Skipped'], '(o_custkey // 5) % 3')} AS guns_answer,
           {_pick(['For', 'Against', 'Not sure'], '(o_orderkey // 11) % 3')} AS taxes_answer
    FROM orders""")
_yes_no = "CASE WHEN {0} IN ('Support', 'For') THEN 1 WHEN {0} IN ('Oppose', 'Against') THEN 0 END"
_cte("labels_recoded", ["survey_labels"], f"""
    SELECT * FROM (
      SELECT {_label_case(fixed.PARTY_LABELS, 'pid7')} AS party_id, {_label_case(fixed.EDUCATION_LABELS, 'educ')} AS education,
             {AGE.format('(2018 - TRY_CAST(birthyr AS INTEGER))')} AS age_band,
             {_yes_no.format('climate_answer')} AS climate, {_yes_no.format('guns_answer')} AS guns,
             {_yes_no.format('taxes_answer')} AS taxes,
             {_label_case(fixed.IDEOLOGY_HALF_POINTS, 'ideo5')} AS ideology_units
      FROM survey_labels)
    WHERE party_id IS NOT NULL AND education IS NOT NULL AND age_band IS NOT NULL""")


def _priors(source: str, scale: int) -> str:
    return f"""
    SELECT party_id, education, age_band,
           coalesce(avg(climate), 0.5) AS p_climate_action_support,
           coalesce(avg(guns), 0.5) AS p_gun_restriction_support,
           coalesce(avg(taxes), 0.5) AS p_tax_on_rich_support,
           coalesce(avg(ideology_units) / {scale}.0, 0.0) AS ideology_score,
           count(*) AS cell_n
    FROM {source} GROUP BY ALL HAVING count(*) >= 5"""


_cte("priors_coded", ["coded"], _priors("coded", 3))
_cte("priors_labels", ["labels_recoded"], _priors("labels_recoded", 2))
_cte("blended", ["priors_coded", "priors_labels"], f"""
    SELECT party_id, education, age_band,
           {', '.join(f'sum({v} * cell_n) / sum(cell_n) AS {v}' for v in VALUES4)}, sum(cell_n)::BIGINT AS blend_n
    FROM (SELECT * FROM priors_coded UNION ALL SELECT * FROM priors_labels)
    WHERE cell_n >= 5 GROUP BY ALL""")
_shares = ", ".join(f"avg((party_id = '{p}')::INTEGER) AS p_{p}" for p in fixed.PARTIES)
_cte("party_dist", ["coded"], f"""
    WITH marginal AS (SELECT age_band, education, {_shares}, count(*) AS n FROM coded GROUP BY ALL HAVING count(*) >= 15),
         by_race AS (SELECT age_band, education, race_eth, {_shares}, count(*) AS n FROM coded
                     WHERE race_eth IS NOT NULL GROUP BY ALL),
         races AS (SELECT unnest([{', '.join(_text(r) for r in fixed.RACES)}]) AS race_eth)
    SELECT m.age_band, m.education, r.race_eth,
           {', '.join(f'CASE WHEN coalesce(b.n, 0) >= 15 THEN b.p_{p} ELSE m.p_{p} END AS p_{p}' for p in fixed.PARTIES)},
           coalesce(b.n, 0) AS cell_n
    FROM marginal m CROSS JOIN races r
    LEFT JOIN by_race b ON b.age_band = m.age_band AND b.education = m.education AND b.race_eth = r.race_eth""")

_nation_states = [fixed.FIPS_STATES.get(f, "US") for f in fx.NATION_FIPS]
_cte("specs", [], f"""
    SELECT c_nationkey AS spec_id,
           CASE WHEN c_nationkey % 5 IN (0, 1) THEN 'US' ELSE {_pick(_nation_states, 'c_nationkey')} END AS scope,
           count(*) AS n, c_nationkey + 42 AS seed
    FROM customer GROUP BY ALL""")
_cte("drawn", ["pool", "specs"], f"""
    WITH line AS (
           SELECT *, sum(person_weight) OVER w - person_weight AS lo, sum(person_weight) OVER w AS hi
           FROM pool WHERE person_weight > 0 WINDOW w AS (ORDER BY {SKELETON})),
         scopes AS (
           SELECT state AS scope, min(lo) AS scope_lo, max(hi) AS scope_hi FROM line GROUP BY state
           UNION ALL SELECT 'US', min(lo), max(hi) FROM line),
         draws AS (SELECT spec_id, scope, seed, unnest(range(n)) AS draw_no FROM specs),
         aimed AS (
           SELECT d.*, (s.scope_lo + {_hash('d.seed', "'cell'", 'd.draw_no')} % (s.scope_hi - s.scope_lo)::BIGINT)::BIGINT AS target
           FROM draws d JOIN scopes s USING (scope))
    SELECT a.spec_id, a.seed, a.draw_no, l.* EXCLUDE (lo, hi, person_weight, record_count)
    FROM aimed a JOIN line l ON a.target >= l.lo AND a.target < l.hi""")
_id = (
    """'{"seed": ' || seed || ', "skeleton": {"age_band": "' || age_band || '", "education": "' || education """
    """|| '", "income_band": "' || income_band || '", "puma": "' || puma || '", "race_eth": "' || race_eth """
    """|| '", "sex": "' || sex || '", "state": "' || state || '"}, "sources": """ + _json_text(VERSIONS) + "}'"
)
_cte("sampled", ["drawn", "party_dist", "blended"], f"""
    WITH partied AS (
      SELECT d.*, CASE WHEN u < coalesce(p_dem, 1.0::DOUBLE / 3.0) THEN 'dem'
                       WHEN u < coalesce(p_dem + p_ind, 2.0::DOUBLE / 3.0) THEN 'ind' ELSE 'rep' END AS party_id
      FROM (SELECT *, {_unit('seed', "'party'", 'draw_no')} AS u FROM drawn) d
      LEFT JOIN (SELECT * FROM party_dist WHERE cell_n >= 5) p USING (age_band, education, race_eth))
    SELECT p.* EXCLUDE (u),
           {', '.join(f"coalesce(b.{v}, {'0.0' if v == 'ideology_score' else '0.5'}) AS {v}" for v in VALUES4)},
           substr(sha256({_id}), 1, 16) AS persona_id
    FROM partied p LEFT JOIN blended b USING (party_id, education, age_band)""")

_cte("votes", [], """
    SELECT 'wa_' || event_type AS measure_id, (user_id % 5)::INTEGER AS group_id, 'p' || user_id AS persona_id,
           event_id AS seq, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 6 END AS round,
           least(1.0, value / 100.0) AS stance, (event_id % 100) / 100.0::DOUBLE AS confidence
    FROM events""")
_cte("personas", [], f"""
    SELECT DISTINCT 'wa_' || event_type AS measure_id, 'p' || user_id AS persona_id, user_id,
           {_pick(fixed.PARTIES, 'user_id % 3')} AS party_id, {_pick(fixed.AGE_BANDS, 'user_id % 4')} AS age_band,
           {_pick(fixed.EDUCATIONS, 'user_id % 5')} AS education,
           CASE WHEN user_id % 50 = 0 THEN 'asian_nh' ELSE {_pick(_other_races, 'user_id % 4')} END AS race_eth
    FROM events""")
_cte("truth", [], """
    SELECT 'wa_' || event_type AS measure_id, 30.0::DOUBLE + (count(*) % 400) / 10.0::DOUBLE AS actual_yes_pct,
           30.0::DOUBLE + (count(*) % 400) / 10.0::DOUBLE > 50.0 AS passed
    FROM events GROUP BY event_type""")
_cte("runs", ["votes"], "SELECT DISTINCT measure_id FROM votes")
# Runs of up to 4,194,304 votes are one block of places.
_cte("interval", ["votes", "runs"], """
    WITH post AS (SELECT measure_id, stance, row_number() OVER (PARTITION BY measure_id ORDER BY seq) - 1 AS place
                  FROM votes WHERE round = 6),
         sizes AS (SELECT measure_id, count(*) AS n FROM post GROUP BY measure_id),
         digests AS (SELECT rep, half, md5('42:' || rep || ':0:' || half) AS digest
                     FROM range(1000) r(rep), range((SELECT max(n) // 2 + 1 FROM sizes)) h(half)),
         draws AS (SELECT rep, 2 * half AS i, ('0x' || substr(digest, 1, 15))::BIGINT AS h FROM digests
                   UNION ALL SELECT rep, 2 * half + 1, ('0x' || substr(digest, 17, 15))::BIGINT FROM digests),
         shares AS (SELECT s.measure_id, d.rep, 100.0 * sum(p.stance) / count(*) AS share
                    FROM sizes s JOIN draws d ON d.i < s.n
                    JOIN post p ON p.measure_id = s.measure_id AND p.place = d.h % s.n
                    GROUP BY s.measure_id, d.rep),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY measure_id ORDER BY share, rep) - 1 AS rank FROM shares)
    SELECT r.measure_id, round(coalesce(max(share) FILTER (rank = 25), 50.0), 9) AS ci_low,
           round(coalesce(max(share) FILTER (rank = 975), 50.0), 9) AS ci_high
    FROM runs r LEFT JOIN ranked k USING (measure_id) GROUP BY r.measure_id""")
_cte("paired", ["votes"], """
    WITH pre AS (SELECT measure_id, persona_id, arg_max(stance, seq) AS pre FROM votes WHERE round = 0 GROUP BY ALL)
    SELECT v.*, p.pre FROM votes v LEFT JOIN pre p USING (measure_id, persona_id) WHERE v.round = 6""")


def _shares_by(keys: str, source: str = "votes") -> str:
    return f"""
    SELECT {keys}, count(*) FILTER (round = 6) AS n_votes,
           coalesce(100.0 * avg((stance > 0.5)::INTEGER) FILTER (round = 6), 50.0) AS yes_pct,
           coalesce(100.0 * avg(stance) FILTER (round = 6), 50.0) AS weighted_pct
    FROM {source} GROUP BY {keys}"""


def _scored_from(shares: str) -> str:
    return f"""
    SELECT s.*, t.actual_yes_pct, t.passed, abs(yes_pct - actual_yes_pct) AS mae_threshold,
           abs(weighted_pct - actual_yes_pct) AS mae_weighted,
           pow(weighted_pct / 100.0 - CASE WHEN passed THEN 1.0 ELSE 0.0 END, 2) AS brier
    FROM {shares} s JOIN truth t USING (measure_id)"""


_cte("shares", ["votes"], _shares_by("measure_id"))
_cte("group_shares", ["votes"], _shares_by("measure_id, group_id"))
_cte("scored", ["shares", "truth"], _scored_from("shares"))
_cte("group_scored", ["group_shares", "truth"], _scored_from("group_shares"))
_cte("change", ["paired", "runs"], """
    SELECT r.measure_id, coalesce(avg(abs(stance - pre)), 0.0) AS mean_abs_delta,
           coalesce(avg(((stance > 0.5) <> (pre > 0.5))::INTEGER), 0.0) AS flip_rate, count(pre) AS n
    FROM runs r LEFT JOIN paired p ON p.measure_id = r.measure_id AND pre IS NOT NULL GROUP BY r.measure_id""")


def _segments(members: str) -> str:
    return f"""
    SELECT m.measure_id, m.axis, m.value, count(p.stance) AS n, count(p.stance) < 5 AS suppressed,
           CASE WHEN count(p.stance) >= 5 THEN 100.0 * avg(p.stance) END AS pred_yes_pct,
           CASE WHEN count(p.stance) >= 5 THEN coalesce(avg(abs(p.stance - p.pre)), 0.0) END AS mean_abs_delta
    FROM ({members}) m LEFT JOIN paired p ON p.measure_id = m.measure_id AND p.persona_id = m.persona_id
    GROUP BY m.measure_id, m.axis, m.value"""


def _members(axes: list[str]) -> str:
    return " UNION ".join(
        f"SELECT measure_id, persona_id, '{a}' AS axis, {a} AS value FROM personas" for a in axes)


_cte("segments", ["personas", "paired"], _segments(_members(["party_id", "age_band", "education", "race_eth"])))

_cte("statements", [], """
    SELECT conv_id AS run_id, turn AS seq,
           CASE WHEN role = 'system' THEN 'moderator' ELSE role || (turn % 3) END AS speaker_id,
           (1 + turn // 2)::INTEGER AS round, text, length(text) % 5 = 0 AS flagged
    FROM conversations""")
_cte("lines", ["statements"], """
    SELECT *, '- ' || speaker_id || ' (round ' || round || ')' || CASE WHEN flagged THEN ' [flagged]' ELSE '' END
              || ': ' || text AS line FROM statements""")
_cte("roster", [], """
    SELECT run_id, persona_id, draw_no FROM (SELECT DISTINCT conv_id AS run_id FROM conversations)
    CROSS JOIN (VALUES ('assistant0', 0), ('assistant1', 1), ('assistant2', 2), ('user0', 3), ('user1', 4), ('user2', 5)) t(persona_id, draw_no)""")
_cte("run_measures", ["statements"], """
    SELECT run_id, arg_min(text, seq) AS framing, (3 + run_id % 4)::INTEGER AS n_rounds,
           CASE WHEN run_id % 3 <> 0 THEN min(speaker_id) || chr(10) || max(speaker_id) ELSE '' END AS sources
    FROM statements GROUP BY run_id""")
_cte("seats", ["roster"], "SELECT *, 'I am ' || persona_id || ' in run ' || (run_id % 7) AS backstory FROM roster")


def _filled(template: str, **fields: str) -> str:
    """A template as SQL text, its places filled with expressions."""
    text = "'" + template.replace("'", "''").replace("{{", chr(1)).replace("}}", chr(2)) + "'"
    for name, value in fields.items():
        text = text.replace("{" + name + "}", f"' || ({value}) || '")
    return text.replace(chr(1), "{").replace(chr(2), "}").replace("\n", "' || chr(10) || '")


def _final(run: str) -> str:
    return f"(SELECT string_agg(line, chr(10) ORDER BY seq) FROM (SELECT * FROM lines x WHERE x.run_id = {run} ORDER BY seq DESC LIMIT 20))"


_cte("speakers", ["statements"], "SELECT DISTINCT run_id, speaker_id FROM statements WHERE speaker_id <> 'moderator'")
_cte("ablated", ["lines", "speakers"], """
    WITH kept AS (
      SELECT s.run_id, s.speaker_id, l.seq, l.line,
             row_number() OVER (PARTITION BY s.run_id, s.speaker_id ORDER BY l.seq DESC) AS back
      FROM speakers s LEFT JOIN lines l ON l.run_id = s.run_id AND l.speaker_id <> s.speaker_id)
    SELECT run_id, speaker_id, coalesce(string_agg(line, chr(10) ORDER BY seq), '(no statements yet)') AS context
    FROM kept WHERE back <= 20 GROUP BY run_id, speaker_id""")

_cte("calls", [], f"""
    SELECT 'wa_' || {_pick(fx.RUNS, 'doc_id % 5')} AS run_id, doc_id AS seq, {_pick(fx.MODELS, '(doc_id // 5) % 6')} AS model,
           greatest(1, n_chars // 4) AS in_tok, greatest(1, n_chars // 16) AS out_tok,
           {_pick([200, 400, 404, 408, 429, 503, None], 'doc_id % 7')} AS status,
           CASE WHEN doc_id % 7 = 4 THEN 'quota reached, retry_delay {{ seconds: ' || (doc_id % 30) || ' }}'
                WHEN doc_id % 7 = 0 THEN NULL ELSE 'call failed' END AS error
    FROM documents""".replace("{{", "{").replace("}}", "}"))
_cte("prices", [], "SELECT model, input::DECIMAL(12,6) AS input, output::DECIMAL(12,6) AS output FROM (VALUES "
     + _values([(m, i, o) for m, (i, o) in fixed.PRICES.items()]) + ") t(model, input, output)")
_cte("priced", ["calls", "prices"], """
    SELECT c.*, ((in_tok::DECIMAL(18,0) * input + out_tok::DECIMAL(18,0) * output) * 0.000001::DECIMAL(7,6))::DECIMAL(38,12) AS usd
    FROM calls c LEFT JOIN prices USING (model)""")


def _planted(plants: list[str]) -> str:
    at = f"doc_id % {2 * len(plants) + 1}"
    return f"CASE WHEN {at} < {len(plants)} THEN text || ' ' || {_pick(plants, f'least({at}, {len(plants) - 1})')} ELSE text END"


_cte("requests", [], f"""
    SELECT doc_id AS request_id, {_planted(fx.REQUEST_PLANTS)} AS text,
           CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + (doc_id % 200)::INTEGER END AS vote_date
    FROM documents""")
_cte("report_texts", [], f"SELECT doc_id, {_planted(fx.OUTPUT_PLANTS)} AS text FROM documents")
_cte("vote_responses", [], """
    SELECT event_id, event_id % 12 AS kind, k,
      CASE event_id % 12
        WHEN 0 THEN '{"stance": 0.' || k || ', "confidence": 0.7, "rationale": "because"}'
        WHEN 1 THEN '{"stance": 0.' || k || ', "confidence": 0.25, "rationale": "fenced"}'
        WHEN 2 THEN '{"stance": "0.' || k || '", "confidence": 1, "rationale": "text number"}'
        WHEN 3 THEN '{}'
        WHEN 4 THEN 'not json 0.' || k
        WHEN 5 THEN '{"stance": null, "confidence": 0.5}'
        WHEN 6 THEN '{"stance": true, "confidence": 0.' || k || '}'
        WHEN 7 THEN '{"stance": 1.5, "confidence": 0.5, "rationale": "too high"}'
        WHEN 8 THEN '{"stance": 0.' || k || '} and more'
        WHEN 9 THEN '{"stance": 0.' || k || ', "rationale": ""}'
        WHEN 10 THEN '{"stance": -0.' || k || ', "confidence": 0.5, "rationale": "too low"}'
        ELSE '{"stance": 0.5, "confidence": 0.' || k || ', "rationale": "' || repeat(k || ' words ', 100) || '"}'
      END AS body
    FROM (SELECT event_id, lpad(regexp_extract(props, '(\\d+)', 1), 2, '0') AS k FROM events)""")
_cte("definitions", [], """
    SELECT doc_id, 'wa_m' || doc_id AS measure_id, 'Measure ' || doc_id AS title,
           regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS framing, source, lang
    FROM documents""")
_cte("probes", [], """
    SELECT 'wa_m' || doc_id AS measure_id, (doc_id % 5)::INTEGER AS seed, doc_id % 6 AS kind,
           30 + doc_id % 40 + (doc_id // 6) % 25 AS recalled, (30 + doc_id % 40)::DOUBLE AS actual_yes_pct
    FROM documents""")
_cte("probes_read", ["probes"], """
    SELECT measure_id, seed, kind IN (0, 3, 4, 5) AS knows,
           CASE WHEN kind IN (0, 4, 5) THEN recalled::DOUBLE END AS yes_pct,
           CASE kind WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.1 WHEN 4 THEN 0.5 WHEN 5 THEN 0.2 ELSE 0.0 END AS confidence,
           CASE kind WHEN 0 THEN 'recalled' WHEN 1 THEN 'unsure' WHEN 2 THEN '[unparseable probe response]' WHEN 5 THEN 'fenced' ELSE '' END AS note,
           actual_yes_pct
    FROM probes""")


def query(needs: list[str], select: str) -> str:
    """A WITH clause of the needed fragments, each after those it needs itself, and the select."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for before in CTES[name][0]:
            visit(before)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    body = select.strip()
    if not ordered:
        return body
    fragments = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(fragments) + ",\n" + body[len("WITH "):]
    return "WITH " + ",\n".join(fragments) + "\n" + body


def _r(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


_vote_literals = [t for x in (cat.CITIZEN, cat.VOTE_REQUEST, cat.CONTEXT_HEADING.replace("{", "{{")) for f, t in _pieces(x) if not f]


def _first_pattern(patterns: list[str]) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(lower(text), {_text(p)}) THEN {i}" for i, p in enumerate(patterns, 1)) + " END"


def _spread(value: str) -> str:
    sd = f"coalesce(stddev_samp({value}), 0.0)"
    return (f"round(avg({value}), 9) AS mean_predicted, round({sd}, 9) AS sd_predicted, "
            f"round(avg({value}) - 1.96 * {sd}, 9) AS ci_low, round(avg({value}) + 1.96 * {sd}, 9) AS ci_high")


_artifact_run = f"'wa_' || {_pick(fx.RUNS, 'conv_id % 5')}"
_sources = "CASE WHEN doc_id % 3 <> 0 THEN '- ' || source || chr(10) || '- ' || lang ELSE '' END"
_pro = "CASE WHEN doc_id % 4 <> 0 THEN '- for ' || lang ELSE '' END"
_con = "CASE WHEN doc_id % 2 <> 0 THEN '- against ' || source || chr(10) || '- cost' ELSE '' END"
_briefing = "'" + BRIEFING_TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
for _name, _expr in (("title", "title"), ("framing", "framing"), ("sources", _sources), ("pro", _pro), ("con", _con)):
    _briefing = _briefing.replace("{" + _name + "}", f"' || {_expr} || '")

_backstory = (
    "'" + fixed.BACKSTORY_FORMAT.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
)
for _field in (
    "age_band", "sex", "race_eth", "education", "income_band", "state", "puma", "party_id",
    "printf('%+.2f', ideology_score)", "printf('%.2f', p_climate_action_support)",
    "printf('%.2f', p_gun_restriction_support)", "printf('%.2f', p_tax_on_rich_support)",
):
    _backstory = _backstory.replace("%s", f"' || {_field.replace('%', '@')} || '", 1)
_backstory = _backstory.replace("@", "%")

_ANSWERS = ", ".join(f"coalesce({a}, {MISSING})::INTEGER AS {a}" for a in ANSWERS)

ORACLE: dict[str, str] = {
    "scan_microdata": query(["microdata"], """
        SELECT ST, count(*) AS records, sum(PWGTP)::BIGINT AS weight, count(SCHL) AS with_schooling,
               count(PINCP) AS with_income FROM microdata GROUP BY ST"""),
    "scan_national": query(["microdata"], """
        SELECT ST, count(*) AS records, sum(PWGTP)::BIGINT AS weight, sum(AGEP)::BIGINT AS ages, count(SCHL) AS with_schooling,
               count(PINCP) AS with_income FROM microdata GROUP BY ST"""),
    "readable_microdata": query(["microdata"], """
        SELECT ST, count(*) AS records, sum(AGEP)::BIGINT AS ages,
               count(PUMA20) FILTER (AGEP <> 41) AS with_area FROM microdata WHERE AGEP <> 40 GROUP BY ST"""),
    "unreadable_microdata": query(["microdata"], """
        SELECT 'AGEP' AS cell_column, 'forty' AS text, false AS kept, count(*) AS n FROM microdata WHERE AGEP = 40
        HAVING count(*) > 0
        UNION ALL
        SELECT 'PUMA20', 'x' || PUMA20, true, count(*) FROM microdata WHERE AGEP = 41 AND PUMA20 IS NOT NULL GROUP BY PUMA20"""),
    "national_load": query(["recoded"], f"""
        SELECT {SKELETON}, coalesce(sum(CASE WHEN PWGTP % 2 = 0 THEN PWGTP ELSE 2 * PWGTP END), 0)::BIGINT AS person_weight,
               count(PWGTP) AS record_count FROM recoded GROUP BY ALL"""),
    "scan_survey_labels": query(["survey_labels"], """
        SELECT pid7 AS party, climate_answer AS climate, count(*) AS n, count(ideo5) AS with_ideology,
               count(*) FILTER (birthyr = 'n/a') AS no_birthyear
        FROM survey_labels GROUP BY ALL"""),
    "scan_survey_coded": """
        SELECT CASE WHEN o_orderkey % 100 = 0 THEN 1 WHEN o_orderkey % 100 < 40 THEN 2 WHEN o_orderkey % 100 < 70 THEN 3
                    WHEN o_orderkey % 100 < 90 THEN 4 WHEN o_orderkey % 100 < 98 THEN 5 ELSE -9 END::INTEGER AS education,
               count(*) AS n, sum(15 + (o_custkey * 7) % 75)::BIGINT AS ages, sum((o_custkey // 3) % 9)::BIGINT AS ideology
        FROM orders GROUP BY 1""",
    "recode_census": query(["recoded"], "SELECT * FROM recoded"),
    "state_lookup": query(["microdata", "states"], """
        SELECT ST, state, count(*) AS records FROM microdata JOIN states ON ST = fips GROUP BY ALL"""),
    "weighted_cells": query(["cells"], "SELECT * FROM cells"),
    "k_anon_pool": query(["pool"], "SELECT * FROM pool"),
    "k_anon_pool_state": query(["pool"], "SELECT * FROM pool WHERE state = 'CA'"),
    "replace_state": query(["cells"], f"""
        SELECT {SKELETON}, CASE WHEN state = 'CA' THEN 2 ELSE 1 END * person_weight AS person_weight, record_count
        FROM cells"""),
    "replace_table": query(["party_dist"], f"""
        SELECT age_band, education, race_eth, {_r(['p_dem', 'p_ind', 'p_rep'], 9)}, 2 * cell_n AS cell_n FROM party_dist"""),
    "source_versions_latest": """
        SELECT event_type AS source_name, arg_max('v' || (event_id % 50), ts) AS version,
               strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS loaded_at FROM events GROUP BY event_type""",
    "source_versions_map": """
        SELECT '{' || string_agg('"' || name || '": "' || version || '"', ', ' ORDER BY name) || '}' AS source_versions
        FROM (SELECT event_type AS name, arg_max('v' || (event_id % 50), ts) AS version FROM events GROUP BY event_type)""",
    "measures": query(["definitions"], """
        SELECT measure_id, 'm' || doc_id AS file_id, title, (2000 + doc_id % 24)::INTEGER AS year, 'WA' AS state, lang AS topic,
               md5(framing) AS framing_md5, source AS briefing,
               CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END AS n_briefing_sources,
               CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END AS n_pro_arguments,
               CASE WHEN doc_id % 2 <> 0 THEN 2 ELSE 0 END AS n_con_arguments,
               CASE WHEN doc_id % 4 <> 0 THEN 3 + doc_id % 4 ELSE 5 END::INTEGER AS n_rounds,
               CASE WHEN doc_id % 5 <> 0 THEN 30 + doc_id % 40 ELSE 50 END::DOUBLE AS yes_pct,
               CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 70 - doc_id % 40 ELSE 50 END::DOUBLE AS no_pct,
               doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND 30 + doc_id % 40 > 50 AS passed
        FROM definitions"""),
    "list_measures": "SELECT DISTINCT 'm' || doc_id AS measure_id FROM documents ORDER BY 1",
    "run_artifact": query(["votes", "personas"], f"""
        WITH v AS (SELECT measure_id, seq // 10000 AS part, count(*) AS n FROM votes GROUP BY ALL),
             s AS (SELECT {_artifact_run} AS measure_id, (conv_id * 100 + turn) // 10000 AS part, count(*) AS n
                   FROM conversations GROUP BY ALL),
             p AS (SELECT measure_id, user_id // 10000 AS part, count(*) AS n,
                          string_agg(persona_id, ',' ORDER BY user_id) FILTER (party_id = 'dem') AS democrats
                   FROM personas GROUP BY ALL)
        SELECT measure_id, 42::BIGINT AS seed, part, 0::INTEGER AS slice, part = 0 AS has_report, coalesce(s.n, 0) AS n_statements,
               coalesce(v.n, 0) AS n_votes, coalesce(p.n, 0) AS n_personas, coalesce(democrats, '') AS democrats
        FROM v FULL JOIN s USING (measure_id, part) FULL JOIN p USING (measure_id, part)"""),
    "explode_artifact": query(["votes"], """
        SELECT measure_id, seq, persona_id, round, round(stance, 9) AS stance, round(confidence, 9) AS confidence,
               'because ' || seq AS rationale FROM votes"""),
    "explode_artifact_statements": query(["statements"], f"""
        SELECT 'wa_' || {_pick(fx.RUNS, 'run_id % 5')} AS measure_id, run_id * 100 + seq AS seq, speaker_id, round,
               md5(text) AS text_md5, flagged FROM statements"""),
    "explode_artifact_personas": query(["personas"], """
        SELECT measure_id, user_id AS draw_no, persona_id, party_id, age_band, education, race_eth FROM personas"""),
    "recode_survey_coded": query(["coded"], f"SELECT party_id, education, age_band, race_eth, {_ANSWERS} FROM coded"),
    "recode_survey_labels": query(["labels_recoded"], f"SELECT party_id, education, age_band, {_ANSWERS} FROM labels_recoded"),
    "priors_coded": query(["priors_coded"], f"SELECT party_id, education, age_band, {_r(VALUES4)}, cell_n FROM priors_coded"),
    "priors_labels": query(["priors_labels"], f"SELECT party_id, education, age_band, {_r(VALUES4)}, cell_n FROM priors_labels"),
    "party_backoff": query(["party_dist"], f"""
        SELECT age_band, education, race_eth, {_r(['p_dem', 'p_ind', 'p_rep'])}, cell_n FROM party_dist"""),
    "priors_blended": query(["blended"], f"SELECT party_id, education, age_band, {_r(VALUES4)}, blend_n FROM blended"),
    "sample_cells": query(["drawn"], f"SELECT spec_id, draw_no, {SKELETON} FROM drawn"),
    "empty_scopes": query(["pool", "specs"], """
        SELECT spec_id, n FROM specs WHERE scope <> 'US' AND scope NOT IN (SELECT state FROM pool WHERE person_weight > 0)
           OR NOT EXISTS (SELECT 1 FROM pool WHERE person_weight > 0)"""),
    "party_draw": query(["sampled"], "SELECT spec_id, draw_no, age_band, education, race_eth, party_id FROM sampled"),
    "persona_priors": query(["sampled"], f"""
        SELECT spec_id, draw_no, party_id, education, age_band, {_r(VALUES4)} FROM sampled"""),
    "persona_id": query(["sampled"], "SELECT spec_id, draw_no, persona_id FROM sampled"),
    "personas": query(["sampled"], f"""
        SELECT spec_id, draw_no, persona_id, {SKELETON}, party_id, {_r(VALUES4)}, seed AS sampling_seed,
               '{VERSIONS['acs']}' AS acs_version FROM sampled"""),
    "sample_composition": query(["sampled"], """
        SELECT 'state' AS axis, state AS value, count(*) AS n FROM sampled GROUP BY state
        UNION ALL SELECT 'party', party_id, count(*) FROM sampled GROUP BY party_id"""),
    "prompt_rows": query(["sampled"], f"SELECT spec_id, draw_no, {_backstory} AS backstory FROM sampled"),
    "vote_prompts": query(["seats", "run_measures", "lines"], f"""
        WITH finals AS (SELECT run_id, {_final('m.run_id')} AS context FROM run_measures m)
        SELECT run_id, persona_id, draw_no, CASE WHEN run_id % 2 = 1 THEN 4 ELSE 2 END AS n_system, 3 AS n_user,
               md5({_filled(cat.CITIZEN, backstory='backstory')} || CASE WHEN run_id % 2 = 1 THEN {_filled(cat.CONTEXT_HEADING)} || context ELSE '' END) AS system_md5,
               md5({_filled(cat.VOTE_REQUEST, framing='framing')}) AS user_md5
        FROM seats JOIN run_measures USING (run_id) JOIN finals USING (run_id)"""),
    "deliberation_prompts": query(["seats", "run_measures", "lines", "statements"], f"""
        SELECT s.run_id, s.seq, 2 AS n_system, 7 AS n_user, md5({_filled(cat.CITIZEN, backstory='t.backstory')}) AS system_md5,
               md5({_filled(cat.TURN_REQUEST, round='s.round', total='m.n_rounds', context='c.context')}) AS user_md5
        FROM statements s JOIN seats t ON t.run_id = s.run_id AND t.persona_id = s.speaker_id JOIN run_measures m ON m.run_id = s.run_id
        JOIN (SELECT run_id, seq, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
                                           '(no statements yet)') AS context FROM lines) c ON c.run_id = s.run_id AND c.seq = s.seq"""),
    "critic_prompts": query(["statements", "run_measures"], f"""
        SELECT s.run_id, s.seq, 1 AS n_system, 5 AS n_user, md5({_filled(cat.CRITIC)}) AS system_md5,
               md5({_filled(cat.CRITIC_REQUEST, statement="CASE WHEN s.seq % 5 <> 4 AND s.text <> '' THEN s.text ELSE '[empty]' END", sources='m.sources')}) AS user_md5
        FROM statements s JOIN run_measures m USING (run_id)"""),
    "probe_prompts": f"""
        SELECT 'wa_m' || doc_id AS measure_id, 1 AS n_system, 9 AS n_user, md5({_filled(cat.PROBE)}) AS system_md5,
               md5({_filled(cat.PROBE_REQUEST, title="'Measure ' || doc_id", state="'WA'", year='2000 + doc_id % 24', framing="'  ' || text || ' ' || chr(10)")}) AS user_md5
        FROM documents""",
    "prompt_segments": query(["seats", "run_measures", "lines"], f"""
        SELECT md5(text) AS key, length(text) AS chars FROM (
            SELECT backstory AS text FROM seats UNION SELECT framing FROM run_measures UNION SELECT {_final('m.run_id')} FROM run_measures m
            UNION SELECT unnest([{', '.join(_filled(p.replace('{', '{{').replace('}', '}}')) for p in _vote_literals)}]))"""),
    "briefing_prompts": query(["definitions"], f"""
        SELECT measure_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars
        FROM (SELECT measure_id, {_briefing} AS prompt FROM definitions)"""),
    "validate_personas": query(["sampled"], """
        SELECT spec_id, draw_no, concat_ws(',',
               CASE WHEN draw_no % 7 = 3 THEN 'age_band' END,
               CASE WHEN draw_no % 5 = 1 THEN 'p_tax_on_rich_support' END,
               CASE WHEN draw_no % 13 = 2 THEN 'ideology_score' END,
               CASE WHEN draw_no % 11 = 4 THEN 'puma' END) AS reasons
        FROM sampled"""),
    "validate_votes": "SELECT event_id, CASE WHEN value / 100.0 > 1.0 OR value < 0 THEN 'stance' ELSE '' END AS reasons FROM events",
    "poststratified_baseline": query(["cells", "party_dist", "blended"], f"""
        WITH w AS (
          SELECT c.state, c.education, c.age_band, t.party_id,
                 c.person_weight * CASE t.party_id WHEN 'dem' THEN coalesce(p_dem, 1.0::DOUBLE / 3.0)
                   WHEN 'ind' THEN coalesce(p_ind, 1.0::DOUBLE / 3.0) ELSE coalesce(p_rep, 1.0::DOUBLE / 3.0) END AS wp
          FROM cells c CROSS JOIN (VALUES ('dem'), ('ind'), ('rep')) t(party_id)
          LEFT JOIN (SELECT * FROM party_dist WHERE cell_n >= 5) p USING (age_band, education, race_eth))
        SELECT state, {', '.join(f"round(sum(wp * coalesce(b.{v}, {'0.0' if v == 'ideology_score' else '0.5'})) / sum(wp), 9) + 0.0 AS {v}" for v in VALUES4)}
        FROM w LEFT JOIN blended b USING (party_id, education, age_band) GROUP BY state"""),
    "yes_share": query(["shares"], f"SELECT measure_id, n_votes, {_r(['yes_pct', 'weighted_pct'])} FROM shares"),
    "opinion_change": query(["change"], f"SELECT measure_id, {_r(['mean_abs_delta', 'flip_rate'])}, n FROM change"),
    "segment_breakdown": query(["segments"], f"""
        SELECT measure_id, axis, value, n, suppressed, {_r(['pred_yes_pct', 'mean_abs_delta'], 9)} FROM segments"""),
    "bootstrap_ci": query(["interval"], "SELECT * FROM interval"),
    "calibration": query(["scored"], f"""
        SELECT measure_id, n_votes, passed,
               {_r(['yes_pct', 'weighted_pct', 'actual_yes_pct', 'mae_threshold', 'mae_weighted', 'brier'])} FROM scored"""),
    "sensitivity": query(["group_scored"], f"""
        SELECT measure_id, count(*) AS n_seeds, round(max(actual_yes_pct), 9) AS actual_yes_pct, {_spread('weighted_pct')},
               round(min(weighted_pct), 9) AS min_predicted, round(max(weighted_pct), 9) AS max_predicted,
               round(max(weighted_pct) - min(weighted_pct), 9) AS spread,
               round(avg(mae_weighted), 9) AS mean_mae, round(avg(brier), 9) AS mean_brier
        FROM group_scored GROUP BY measure_id"""),
    "multigroup": query(["group_shares", "scored", "interval", "votes"], f"""
        WITH named AS (
          SELECT * REPLACE (CASE WHEN substr(persona_id, 2)::BIGINT % 10 = 1
                                 THEN 'p' || (substr(persona_id, 2)::BIGINT - 1) ELSE persona_id END AS persona_id) FROM votes),
        before AS (SELECT measure_id, persona_id, arg_max(stance, seq) AS pre FROM named WHERE round = 0 GROUP BY ALL),
        moved AS (SELECT measure_id, avg(abs(stance - pre)) AS mean_abs_delta, avg(((stance > 0.5) <> (pre > 0.5))::INTEGER) AS flip_rate,
                         count(*) AS n
                  FROM named JOIN before USING (measure_id, persona_id) WHERE round = 6 GROUP BY measure_id)
        SELECT g.*, round(s.weighted_pct, 9) AS pooled_predicted, round(s.actual_yes_pct, 9) AS actual_yes_pct,
               round(s.mae_weighted, 9) AS mae_weighted, round(coalesce(c.mean_abs_delta, 0.0), 9) AS mean_abs_delta,
               round(coalesce(c.flip_rate, 0.0), 9) AS flip_rate, coalesce(c.n, 0) AS n_matched,
               i.ci_low AS pooled_ci_low, i.ci_high AS pooled_ci_high
        FROM (SELECT measure_id, count(*) AS n_groups, sum(n_votes)::BIGINT AS n_votes, {_spread('weighted_pct')}
              FROM group_shares GROUP BY measure_id) g
        JOIN scored s USING (measure_id) JOIN interval i USING (measure_id) LEFT JOIN moved c USING (measure_id)"""),
    "multigroup_segments": query(["personas", "paired"], f"""
        SELECT measure_id, axis, value, n, suppressed, {_r(['pred_yes_pct', 'mean_abs_delta'], 9)}
        FROM ({_segments(_members(['party_id', 'education']))})"""),
    "backtest_summary": query(["group_scored", "personas", "priced"], """
        SELECT s.measure_id, grouping(s.measure_id)::INTEGER AS level, count(*) AS n_runs, sum(n_personas)::BIGINT AS n_personas,
               round(avg(weighted_pct), 9) AS predicted, round(avg(actual_yes_pct), 9) AS actual,
               round(avg(mae_weighted), 9) AS mae, round(avg(brier), 9) AS brier, round(sum(coalesce(cost, 0.0)), 9) AS cost_usd
        FROM group_scored s
        JOIN (SELECT measure_id, (user_id % 5)::INTEGER AS group_id, count(*) AS n_personas FROM personas GROUP BY ALL) p USING (measure_id, group_id)
        LEFT JOIN (SELECT run_id AS measure_id, ((seq // 7) % 5)::INTEGER AS group_id, sum(usd)::DOUBLE AS cost FROM priced GROUP BY ALL) c
             USING (measure_id, group_id)
        GROUP BY ROLLUP (s.measure_id)"""),
    "segment_error": query(["segments"], f"""
        SELECT measure_id, axis, value, n, {_r(['pred_yes_pct', 'certified_yes_pct'])},
               round(abs(pred_yes_pct - certified_yes_pct), 9) AS abs_error
        FROM segments JOIN (
          SELECT 'wa_' || event_type AS measure_id, 'party_id' AS axis, {_pick(fixed.PARTIES, 'user_id % 3')} AS value,
                 20.0::DOUBLE + (count(*) % 600) / 10.0::DOUBLE AS certified_yes_pct
          FROM events GROUP BY ALL) USING (measure_id, axis, value)
        WHERE NOT suppressed"""),
    "protected_segments": query(["segments"], f"""
        WITH marked AS (SELECT *, n BETWEEN 1 AND 4 AS small FROM segments),
             summed AS (SELECT *, bool_or(small) OVER (PARTITION BY measure_id, axis) AS anyone,
                               coalesce(count(*) FILTER (n > 0) OVER w, 0) AS taken, coalesce(sum(n) OVER w, 0) AS votes
                        FROM marked
                        WINDOW w AS (PARTITION BY measure_id, axis ORDER BY small DESC, n, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             told AS (SELECT *, CASE WHEN small THEN 'small' WHEN anyone AND n > 0 AND (taken < 2 OR votes < 5) THEN 'complement' END AS withheld FROM summed)
        SELECT measure_id, axis, value, n, suppressed, withheld,
               round(CASE WHEN withheld IS NULL THEN pred_yes_pct END, 9) + 0.0 AS pred_yes_pct,
               round(CASE WHEN withheld IS NULL THEN mean_abs_delta END, 9) + 0.0 AS mean_abs_delta
        FROM told"""),
    "uncertified_segments": query(["segments"], f"""
        SELECT measure_id, axis, value, n FROM segments
        WHERE NOT suppressed AND (measure_id, axis, value) NOT IN (
          SELECT 'wa_' || event_type, 'party_id', {_pick(fixed.PARTIES, 'user_id % 3')} FROM events)"""),
    "model_divergence": query(["group_scored"], """
        SELECT measure_id, count(*) AS n_models, round(min(w), 9) AS min_predicted, round(max(w), 9) AS max_predicted,
               round(max(w) - min(w), 9) AS divergence, arg_min(model, w) AS lowest_model, arg_max(model, w) AS highest_model
        FROM (SELECT measure_id, 'model-' || (group_id % 2) AS model, avg(weighted_pct) AS w FROM group_scored GROUP BY ALL)
        GROUP BY measure_id"""),
    "run_grid": """
        SELECT 'wa_m' || doc_id AS measure_id, seed::INTEGER AS seed, group_id::INTEGER AS group_id, (seed + group_id)::INTEGER AS run_seed
        FROM documents CROSS JOIN range(1, 6) s(seed) CROSS JOIN range(3) g(group_id)""",
    "parse_votes": query(["vote_responses"], f"""
        WITH read AS (
          SELECT event_id, json_valid(body) AS valid, CASE WHEN json_valid(body) THEN body END AS j FROM vote_responses),
        typed AS (
          SELECT event_id, valid, json_type(j, '$.stance') AS st, json_type(j, '$.confidence') AS ct,
                 json_extract_string(j, '$.stance') AS s, json_extract_string(j, '$.confidence') AS c,
                 json_extract_string(j, '$.rationale') AS r FROM read),
        numbers AS (
          SELECT event_id, r, coalesce(valid, false) AND coalesce(st, '') <> 'NULL' AND coalesce(ct, '') <> 'NULL' AS ok,
                 CASE s WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE TRY_CAST(s AS DOUBLE) END AS s,
                 CASE c WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 ELSE TRY_CAST(c AS DOUBLE) END AS c
          FROM typed)
        SELECT event_id, CASE WHEN ok THEN round(greatest(0.0, least(1.0, coalesce(s, 0.5))), 9) ELSE 0.5 END + 0.0 AS stance,
               CASE WHEN ok THEN round(greatest(0.0, least(1.0, coalesce(c, 0.5))), 9) ELSE 0.3 END + 0.0 AS confidence,
               CASE WHEN ok THEN substr(coalesce(r, ''), 1, 600) ELSE {_text(fixed.UNPARSEABLE_VOTE)} END AS rationale
        FROM numbers"""),
    "parse_critic": r"""
        SELECT doc_id, doc_id % 6 IN (0, 3) AS flagged,
               nullif(CASE doc_id % 6 WHEN 0 THEN substr(said, 1, 300) WHEN 3 THEN substr('doc ' || doc_id || ' ' || said, 1, 300)
                    WHEN 4 THEN substr(said, 1, 300) END, '') AS note
        FROM (SELECT doc_id, regexp_replace(text, '[\\"\x00-\x1f]', ' ', 'g') AS said FROM documents)""",
    "parse_probe": query(["probes_read"], """
        SELECT measure_id, seed, knows, round(yes_pct, 9) AS yes_pct, round(confidence, 9) AS confidence, note FROM probes_read"""),
    "strip_fences": r"""
        SELECT doc_id, md5(regexp_replace(CASE doc_id % 4 WHEN 2 THEN replace(text, chr(10), ' ') ELSE text END, '^\s+|\s+$', '', 'g')) AS stripped_md5
        FROM documents""",
    "contamination_flags": query(["probes_read"], """
        SELECT measure_id, seed, knows, round(yes_pct, 9) AS yes_pct, actual_yes_pct,
               CASE WHEN knows THEN abs(yes_pct - actual_yes_pct) END AS recall_error,
               CASE WHEN NOT knows OR yes_pct IS NULL THEN 'NONE' WHEN abs(yes_pct - actual_yes_pct) <= 5 THEN 'HIGH'
                    WHEN abs(yes_pct - actual_yes_pct) <= 15 THEN 'MODERATE' ELSE 'LOW' END AS flag
        FROM probes_read"""),
    "policy_input": query(["requests"], f"SELECT request_id, coalesce({_first_pattern(fixed.REQUEST_PATTERNS)}, 0) AS pattern_no FROM requests"),
    "policy_window": query(["requests"], f"""
        SELECT request_id, reason IS NOT NULL AS refused, reason FROM (
          SELECT request_id, CASE WHEN {_first_pattern(fixed.REQUEST_PATTERNS)} IS NOT NULL THEN 'category'
                 WHEN vote_date - DATE '2024-02-01' BETWEEN 0 AND 60 THEN 'vote_window' END AS reason FROM requests)"""),
    "policy_output": query(["report_texts"], f"""
        SELECT doc_id, length(text) AS n_chars FROM report_texts WHERE {_first_pattern(fixed.OUTPUT_PATTERNS)} IS NULL"""),
    "recent_context": query(["lines"], """
        SELECT run_id, seq, speaker_id, round, md5(coalesce(array_to_string(list(line) OVER w, chr(10)), '(no statements yet)')) AS context_md5
        FROM lines WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"""),
    "final_context": query(["lines"], """
        SELECT run_id, md5(string_agg(line, chr(10) ORDER BY seq)) AS context_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back FROM lines)
        WHERE back <= 20 GROUP BY run_id"""),
    "ablated_context": query(["ablated"], "SELECT run_id, speaker_id, md5(context) AS context_md5 FROM ablated"),
    "statement_counts": query(["statements"], """
        SELECT run_id, speaker_id, count(*) AS n_statements, count(*) FILTER (flagged) AS n_flagged
        FROM statements GROUP BY ALL"""),
    "next_speakers": query(["roster", "statements"], """
        WITH counted AS (
          SELECT r.run_id, r.persona_id, r.draw_no, count(s.seq) AS n_spoken
          FROM roster r LEFT JOIN statements s ON s.run_id = r.run_id AND s.speaker_id = r.persona_id GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n_spoken, persona_id, draw_no) AS turn,
                          count(*) OVER (PARTITION BY run_id) AS seats FROM counted)
        SELECT run_id, persona_id, draw_no, n_spoken, turn FROM placed WHERE turn <= greatest(1, seats // 3)"""),
    "speaker_influence": query([], f"""
        WITH said AS (SELECT 'wa_' || {_pick(fx.RUNS, 'conv_id % 5')} AS run_id, 's' || ((conv_id + turn) % 9) AS speaker_id,
                             count(*) AS n_statements
                      FROM conversations WHERE role <> 'system' GROUP BY ALL),
             base AS (SELECT event_type, user_id, arg_max(least(1.0, value / 100.0), event_id) AS b
                      FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
             moved AS (SELECT 'wa_' || e.event_type AS run_id, 's' || (event_id % 7) AS speaker_id,
                              b - least(1.0, value / 100.0) AS shift
                       FROM events e LEFT JOIN base USING (event_type, user_id) WHERE ts >= TIMESTAMP '2024-01-16')
        SELECT run_id, speaker_id, coalesce(any_value(n_statements), 0) AS n_statements, count(shift) AS n_personas,
               count(*) FILTER (shift IS NULL AND voted) AS n_unmatched,
               round(coalesce(avg(shift), 0.0), 9) + 0.0 AS mean_signed_shift, round(coalesce(avg(abs(shift)), 0.0), 9) AS mean_abs_shift
        FROM said FULL JOIN (SELECT *, true AS voted FROM moved) USING (run_id, speaker_id) GROUP BY run_id, speaker_id"""),
    "unknown_models": query(["calls", "prices"], """
        SELECT model, count(*) AS calls FROM calls WHERE model NOT IN (SELECT model FROM prices) GROUP BY model"""),
    "spend_by_model": query(["priced"], """
        SELECT run_id, model, count(*) AS calls, sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok,
               round(sum(usd)::DOUBLE, 9) AS usd, count(*) FILTER (usd IS NULL) AS unpriced_calls, grouping(run_id, model)::INTEGER AS level
        FROM priced GROUP BY ROLLUP (run_id, model)"""),
    "budget_cap": query(["priced"], f"""
        WITH r AS (SELECT *, coalesce(usd, 0) AS charge,
                          sum(coalesce(usd, 0)) OVER (PARTITION BY run_id ORDER BY seq) AS running FROM priced)
        SELECT run_id, seq, round(usd::DOUBLE, 9) AS usd, round(running::DOUBLE, 9) AS running_usd,
               running - charge <= {CAP_USD} AS allowed, running > {CAP_USD} AND running - charge <= {CAP_USD} AS breach,
               usd IS NULL AS unpriced
        FROM r"""),
    "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
    "model_stamp": query(["calls"], """
        SELECT run_id, 'gemini:' || string_agg(DISTINCT model, '+' ORDER BY model) AS stamp FROM calls GROUP BY run_id"""),
    "retry_classes": query(["calls"], r"""
        SELECT run_id, seq, coalesce(status, -9) AS status, status IS NULL OR status IN (408, 429) OR status >= 500 AS retryable,
               TRY_CAST(nullif(regexp_extract(error, 'seconds:\s*(\d+)', 1), '') AS DOUBLE) AS delay_s
        FROM calls"""),
}
