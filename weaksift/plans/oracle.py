"""The registered queries as DuckDB SQL, written from the rules, not from the Spark plans.

Here every term is tested on the full text and every number comes from one global window,
which is what the Spark side must equal.
"""

from __future__ import annotations

from weaksift import lexicons as X
from weaksift.operators import summaries as U
from weaksift.plans.seeded import PHRASES

SPACE = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"
BATCH = 100
THRESHOLDS = [0.12, 0.5, 0.8, 0.9]
DENSE_THRESHOLDS = [0.3, 0.35, 0.4]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(terms: list[str]) -> str:
    return "[" + ", ".join(lit(t) for t in terms) + "]" if terms else "[]::VARCHAR[]"


def sub(column: str, terms: list[str]) -> str:
    return f"list_filter({arr(terms)}, lambda t: contains({column}, t))"


def word(text: str, tokens: str, terms: list[str]) -> str:
    return (
        f"list_filter({arr(terms)}, lambda t: CASE WHEN regexp_full_match(t, '[a-z0-9]+') "
        f"THEN list_contains({tokens}, t) ELSE contains({text}, t) END)"
    )


def some(hits: str) -> str:
    return f"(len({hits}) > 0)"


def reason(code: str, column: str, first: int) -> str:
    return f"{lit(code + ':')} || array_to_string({column}[1:{first}], ', ')"


def reasons(cases: list[tuple[str, str]]) -> str:
    whens = ", ".join(f"CASE WHEN {condition} THEN {text} END" for condition, text in cases)
    return f"list_filter([{whens}], lambda x: x IS NOT NULL)"


def clean(column: str) -> str:
    return f"trim(regexp_replace({column}, {lit(SPACE)}, ' ', 'g'))"


def cut(column: str, n: int, trim: bool = True) -> str:
    head = f"substr({column}, 1, {n - 3})"
    if trim:
        head = f"rtrim({head})"
    return f"CASE WHEN length({column}) <= {n} THEN {column} ELSE {head} || '...' END"


def words_in(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN 0 ELSE len(string_split({column}, ' ')) END"


D = X.DOMAIN

BANK = ",\n".join(
    f"({i}, {lit(t)}, {lit(r)}, {lit(title)}, {lit(p)})" for i, (t, r, title, p) in enumerate(PHRASES)
)

SEEDED = rf"""
bank(k, source_type, rating, title, phrase) AS (VALUES {BANK}),
seeded AS (
  SELECT d.doc_id + 1 AS source_index, 'run-' || lpad(regexp_extract(d.source, '(\d+)', 1), 2, '0') AS run_id,
    b.source_type, d.source AS source_name, d.doc_id::VARCHAR AS source_id,
    'https://items.example/' || d.doc_id AS source_url, b.title AS title, d.lang AS author,
    'theme-' || d.lang AS product_theme, d.lang AS query_theme, b.rating AS rating,
    b.phrase || ' ' || d.text AS text, d.doc_id % 50 = 0 AS is_demo_fallback, d.doc_id AS doc_id
  FROM documents d JOIN bank b ON b.k = d.doc_id % {len(PHRASES)}
)"""

def assessed(d: dict, source: str = "seeded") -> str:
    return rf"""
cleaned AS (SELECT *, {clean('text')} AS clean_text FROM {source}),
texts AS (
  SELECT *, lower(clean_text) AS low, ' ' || lower(clean_text) || ' ' AS padded_low,
    lower(title || ' ' || clean_text) AS combined, ' ' || lower(title || ' ' || clean_text) || ' ' AS padded,
    {words_in('clean_text')} AS n_words
  FROM cleaned
),
matched AS (
  SELECT *, {sub('combined', d['job'])} AS job, {sub('combined', d['promotional'])} AS promo,
    {sub('combined', d['directory'])} AS listing, {sub('padded', d['conversational'])} AS talk,
    {sub('combined', d['quality'])} AS qual,
    contains(combined, 'remote') AND {some(sub('combined', d['remote_job_context']))} AS remote_job,
    {some(f"list_filter({arr(d['company_openings'])}, lambda t: starts_with(low, t))")}
      AND {some(sub('low', d['promotional']))} AND NOT {some(sub('padded_low', d['customer_voice']))} AS self_description,
    n_words BETWEEN 8 AND 220 AND regexp_matches(clean_text, '[.?!]')
      AND {some(sub('low', d['opinion_markers']))} AS comment_like,
    n_words BETWEEN 6 AND 260 AND ({some(sub('padded_low', d['experience_markers']))}
      OR {some(sub('low', d['quality']))}) AS review_like
  FROM texts
),
rated AS (
  SELECT *, (len(talk) > 0)::INT + least(2, len(qual)) + (source_type = 'review' AND rating <> '')::INT
    + (source_type = 'discussion' AND comment_like)::INT + (source_type = 'review' AND review_like)::INT AS quality_score,
    {reasons([
      ("len(talk) > 0", "'conversational_language:' || trim(array_to_string(talk[1:3], ', '))"),
      ("len(qual) > 0", reason("venture_signal_language", "qual", 5)),
      ("source_type = 'review' AND rating <> ''", "'has_customer_rating'"),
      ("source_type = 'discussion' AND comment_like", "'comment_like_length_or_style'"),
      ("source_type = 'review' AND review_like", "'review_like_experience_statement'"),
    ])} AS found_reasons
  FROM matched
),
assessed AS MATERIALIZED (
  SELECT *, CASE WHEN len(found_reasons) > 0 THEN found_reasons ELSE ['low_user_evidence_signal'] END AS quality_reasons,
    {reasons([
      ("len(job) > 0", reason("job_or_careers_language", "job", 4)),
      ("remote_job", "'job_or_careers_language:remote_with_job_context'"),
      ("len(promo) >= 2", reason("promotional_or_landing_copy", "promo", 4)),
      ("len(listing) > 0", reason("directory_or_listing_snippet", "listing", 4)),
      ("self_description", "'company_self_description'"),
      ("clean_text = ''", "'empty_text'"),
      ("source_type = 'discussion' AND quality_score < 2", "'discussion_text_not_comment_like'"),
      ("source_type = 'review' AND quality_score < 2", "'review_text_not_customer_feedback_like'"),
    ])} AS exclude_reasons,
    len(exclude_reasons) = 0 AS kept, (source_index - 1) // {BATCH} + 1 AS batch_index
  FROM rated
)"""


ASSESSED = assessed(D)

def scope(d: dict) -> list[str]:
    return d["business_scope"] + d["workflow_friction"] + d["practical_tool"]


def process(d: dict) -> list[str]:
    return d["workflow_friction"] + d["practical_tool"]


def pain(d: dict) -> list[str]:
    return d["adoption"] + d["dissatisfaction"]


NON_WORD = r"[^\p{L}\p{N}_]+"


def flags(text: str, tokens: str, d: dict) -> str:
    """anchored, concrete, unmet, process_hit, pain_hit for a lower-cased text."""
    pad = f"(' ' || {text} || ' ')"
    w = lambda terms: some(word(text, tokens, terms))
    return f"""
    {w(d['context_anchor'])} AS anchored,
    {w(scope(d))} AND {w(pain(d))} AND {some(sub(pad, d['pain_actors']))} AS concrete,
    {w(d['unmet_need'])} AND {w(d['context_anchor'])} AND {w(process(d) + d['unmet_need_setting'])} AS unmet,
    {w(d['context_anchor'])} AND {w(pain(d))} AND {w(process(d))} AS anchored_pain"""


def groups(d: dict, prefix: str) -> list[tuple[str, list[str]]]:
    return [(name.removeprefix(prefix), terms) for name, terms in d.items() if name.startswith(prefix)]


def prepared(d: dict) -> str:
    return rf"""
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source_index) AS item_no,
    source_type || '-' || row_number() OVER (ORDER BY source_index) AS item_id,
    string_split_regex(combined, {lit(NON_WORD)}) AS toks
  FROM assessed WHERE kept
),
hits AS (
  SELECT *, {', '.join(f"{word('combined', 'toks', d[n])} AS h_{n}" for n in (
      'business_scope', 'workflow_friction', 'practical_tool', 'ai_operational', 'adoption', 'dissatisfaction',
      'promotion', 'cultural_quote', 'technical_detail', 'generic_enterprise', 'quote'))},
    {flags('combined', 'toks', d)},
    {some(sub('padded', d['first_person_actors']))} AND {some(sub('combined', pain(d)))} AS first_person,
    {some(sub('combined', d['generic_scope_escape']))} AS scope_escape,
    len(regexp_extract_all(low, 'https?://|www\.')) AS links
  FROM numbered
),
counted AS (
  SELECT *, len(h_business_scope) AS b, len(h_workflow_friction) AS w, len(h_practical_tool) AS p,
    len(h_ai_operational) AS ai, len(h_adoption) AS ad, len(h_dissatisfaction) AS di, len(h_promotion) AS pr,
    len(h_cultural_quote) AS cu, len(h_technical_detail) AS te, len(h_generic_enterprise) AS ge, len(h_quote) AS qu,
    links >= 2 OR (links = 1 AND greatest(1, n_words) < 35) AS link_drop,
    b + w + p > 0 AS context
  FROM hits
),
ruled AS (
  SELECT *, CASE WHEN te >= 5 AND NOT concrete THEN 1 WHEN te >= 3 AND NOT context THEN 2
      WHEN te >= 2 AND b + w = 0 THEN 3 WHEN te >= 4 AND context AND NOT concrete THEN 4 ELSE 0 END AS tech_rule
  FROM counted
),
scored AS (
  SELECT *,
    least(9, 3 * b) + least(8, 2 * w) + least(5, 2 * p) + CASE WHEN b + w > 0 THEN least(3, ai) ELSE 0 END
    + least(5, ad) + least(4, di) + CASE WHEN first_person THEN 2 ELSE 0 END
    + CASE WHEN source_type = 'review' AND context THEN 1 ELSE 0 END
    - CASE WHEN pr = 0 THEN 0 WHEN concrete THEN 4 ELSE 11 END
    - CASE WHEN link_drop THEN 4 ELSE 0 END
    - CASE WHEN cu = 0 THEN 0 WHEN anchored THEN 5 ELSE 14 END
    - [0, 10, 8, 5, 3][tech_rule + 1]
    - CASE WHEN ge > 0 AND NOT scope_escape THEN 4 ELSE 0 END
    - CASE WHEN qu > 0 AND ad + di = 0 AND NOT anchored THEN 7 ELSE 0 END
    - CASE WHEN NOT anchored THEN 10 WHEN NOT context AND ad + di = 0 THEN 4 ELSE 0 END AS relevance_score,
    {reasons([
      ("b > 0", reason("business_scope_terms", "h_business_scope", 6)),
      ("w > 0", reason("workflow_friction_terms", "h_workflow_friction", 6)),
      ("p > 0", reason("practical_tool_terms", "h_practical_tool", 6)),
      ("ai > 0 AND b + w > 0", reason("ai_operational_terms", "h_ai_operational", 4)),
      ("ad > 0", reason("adoption_terms", "h_adoption", 6)),
      ("di > 0", reason("dissatisfaction_terms", "h_dissatisfaction", 6)),
      ("first_person", "'first_person_or_team_problem'"),
      ("source_type = 'review' AND context", "'implementation_feedback_source'"),
    ])} AS gains,
    {reasons([
      ("pr > 0 AND concrete", reason("promotion_with_some_user_pain", "h_promotion", 4)),
      ("pr > 0 AND NOT concrete", reason("founder_launch_or_self_promotion", "h_promotion", 4)),
      ("link_drop", "'link_drop_density'"),
      ("cu > 0 AND anchored", reason("cultural_or_quote_reference_with_context", "h_cultural_quote", 4)),
      ("cu > 0 AND NOT anchored", reason("cultural_or_quote_reference_no_operational_context", "h_cultural_quote", 4)),
      ("tech_rule = 1", reason("engineering_heavy_weak_venture_context", "h_technical_detail", 6)),
      ("tech_rule = 2", reason("low_level_technical_debugging", "h_technical_detail", 5)),
      ("tech_rule = 3", reason("api_or_debug_detail_weak_business_context", "h_technical_detail", 5)),
      ("tech_rule = 4", reason("technical_detail_needs_stronger_operational_pain", "h_technical_detail", 5)),
      ("ge > 0 AND NOT scope_escape", reason("generic_enterprise_weak_scope", "h_generic_enterprise", 4)),
      ("qu > 0 AND ad + di = 0 AND NOT anchored", reason("off_topic_or_quote_like", "h_quote", 3)),
      ("NOT anchored", "'missing_business_workflow_or_tool_context_anchor'"),
      ("anchored AND NOT context AND ad + di = 0", "'weak_operational_tool_relevance'"),
    ])} AS relevance_penalties
  FROM ruled
),
decided AS (
  SELECT *, CASE WHEN len(gains) > 0 THEN gains ELSE ['low_positive_relevance'] END AS relevance_reasons,
    NOT anchored OR (source_type = 'discussion' AND NOT (concrete OR unmet OR anchored_pain))
    OR (pr > 0 AND NOT concrete) OR (te >= 5 AND NOT concrete) OR relevance_score < 4 AS exclude_for_relevance
  FROM scored
),
reasoned AS (
  SELECT *, array_to_string(quality_reasons, '; ') AS q_text, array_to_string(relevance_reasons, '; ') AS r_text,
    array_to_string(relevance_penalties, '; ') AS p_text,
    combined || ' ' || lower(array_to_string(relevance_reasons, '; ')) AS label_text,
    combined || ' ' || lower(array_to_string(relevance_reasons, '; ')) || ' '
      || lower(array_to_string(quality_reasons, '; ')) AS item_text
  FROM decided
),
prepared AS MATERIALIZED (
  SELECT *,
    {reasons([(some(sub('label_text', terms)), lit(name)) for name, terms in groups(d, 'label.')]
             + [("source_type = 'review'", "'implementation_feedback'")])} AS labels,
    coalesce(labels[1], 'general_signal') AS primary_label,
    [{', '.join(f"len({sub('item_text', terms)})" for _, terms in groups(d, 'bucket.'))}] AS bucket_counts,
    CASE WHEN list_max(bucket_counts) = 0 THEN {lit(X.GENERAL_BUCKET)}
      ELSE {arr([name for name, _ in groups(d, 'bucket.')])}[list_position(bucket_counts, list_max(bucket_counts))] END AS bucket
  FROM reasoned
),
items AS (SELECT * FROM prepared WHERE NOT exclude_for_relevance)"""


PREPARED = prepared(D)

TITLE_CASE = " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in X.CATEGORY_TITLES.items())


def evidence(d: dict) -> str:
    """The evidence rows under a lexicon; a category without a title is told by its name."""
    hits = lambda name: f"len({word('x', 'xt', d[name])})"
    return rf"""
excerpts AS (
  SELECT *, {cut('clean_text', 240)} AS evidence_excerpt,
    lower(title || ' ' || {cut('clean_text', 240)}) AS x,
    string_split_regex(lower(title || ' ' || {cut('clean_text', 240)}), {lit(NON_WORD)}) AS xt
  FROM (SELECT * EXCLUDE (anchored, concrete, unmet, anchored_pain) FROM items)
),
flagged AS (
  SELECT *, {flags('x', 'xt', d)},
    {hits('promotion')} > 0 AS x_promo, {hits('cultural_quote')} > 0 AS x_cult,
    {hits('technical_detail')} AS x_tech, {hits('technical_allowance')} > 0 AS x_allowed,
    {hits('adoption')} * 2 + {hits('strong_adoption')} * 3 AS x_adopt,
    {hits('dissatisfaction')} * 2 + {hits('strong_dissatisfaction')} * 3 AS x_diss,
    {hits('business_scope')} + {hits('workflow_friction')} AS x_scope,
    {hits('technical_direct_context')} > 0 OR ({hits('technical_setup_context')} > 0
      AND len({word('x', 'xt', scope(d))}) > 0) AS x_grade
  FROM excerpts
),
signals AS (
  {' UNION ALL '.join(
    f"SELECT *, {i} AS category_ord, {lit(name)} AS category, {sub('low', terms)} AS all_terms FROM flagged"
    for i, (name, terms) in enumerate(groups(d, 'signal.')))}
),
signal_scores AS (
  SELECT *, all_terms[1:6] AS matched_terms, CASE category {TITLE_CASE} ELSE category END AS category_title,
    relevance_score + CASE category WHEN 'adoption_barriers' THEN x_adopt
      WHEN 'dissatisfaction_current_solutions' THEN x_diss WHEN 'recurring_problem_signals' THEN x_scope
      WHEN 'unmet_needs' THEN CASE WHEN unmet THEN 0 ELSE -12 END ELSE 0 END
    - CASE WHEN x_promo AND NOT concrete THEN 8 ELSE 0 END
    - CASE WHEN x_cult AND NOT anchored THEN 14 ELSE 0 END - CASE WHEN anchored THEN 0 ELSE 10 END
    - CASE WHEN x_tech >= 3 AND NOT x_allowed THEN 8 WHEN x_tech >= 5 AND NOT concrete THEN 6 ELSE 0 END
      AS signal_relevance_score
  FROM signals WHERE len(all_terms) > 0
),
evidence AS MATERIALIZED (
  SELECT * FROM signal_scores
  WHERE anchored AND (category <> 'unmet_needs' OR unmet)
    AND (source_type <> 'discussion' OR concrete OR unmet OR anchored_pain)
    AND (NOT x_promo OR concrete) AND (x_tech < 5 OR x_grade) AND signal_relevance_score >= 4
)"""


EVIDENCE = evidence(D)

CATEGORIES = ", ".join(
    f"({i}, {lit(c)}, {lit(t)})" for i, (c, t) in enumerate(X.CATEGORY_TITLES.items(), start=1)
)

SUMMARY = rf"""
titled(summary_ord, category, title) AS (VALUES {CATEGORIES}),
categories AS (
  FROM titled UNION ALL SELECT {len(X.CATEGORY_TITLES)} + row_number() OVER (ORDER BY category), category, category
  FROM (SELECT DISTINCT category FROM evidence WHERE category NOT IN (SELECT category FROM titled))
),
ranked_evidence AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY signal_relevance_score DESC, item_no, category_ord) AS place
  FROM evidence
),
term_rows AS (
  SELECT category, place, unnest(matched_terms) AS term, generate_subscripts(matched_terms, 1) AS pos FROM ranked_evidence
),
term_counts AS (
  SELECT category, term, count(*) AS n, min(place * 100 + pos) AS first_seen FROM term_rows GROUP BY ALL
),
term_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first_seen) AS place FROM term_counts
),
top_terms AS (SELECT category, list(term ORDER BY place) AS terms FROM term_ranks WHERE place <= 5 GROUP BY ALL),
examples AS (
  SELECT category, list(evidence_excerpt ORDER BY place) AS texts, list(signal_relevance_score ORDER BY place) AS scores
  FROM ranked_evidence WHERE place <= 3 GROUP BY ALL
),
category_counts AS (
  SELECT category, count(*) AS n, count(*) FILTER (source_type = 'discussion') AS nd,
    count(*) FILTER (source_type = 'review') AS nr
  FROM evidence GROUP BY ALL
),
summary AS MATERIALIZED (
  SELECT c.summary_ord, c.category, c.title, coalesce(n, 0) AS evidence_count, coalesce(nd, 0) AS discussion_count,
    coalesce(nr, 0) AS review_count, coalesce(terms, []) AS top_terms,
    CASE WHEN n IS NULL THEN {lit(U.NO_EVIDENCE)} ELSE 'Found ' || n || ' evidence item(s). Common indicators: '
      || array_to_string(terms, ', ') || '.' END AS summary,
    coalesce(texts, []) AS example_evidence, coalesce(scores, []) AS example_scores
  FROM categories c LEFT JOIN category_counts USING (category) LEFT JOIN top_terms USING (category)
    LEFT JOIN examples USING (category)
)"""

VECTORS = rf"""
all_tokens AS (
  SELECT item_no, item_id, bucket, relevance_score,
    list_filter(regexp_extract_all(item_text, '[a-z][a-z0-9-]{{2,}}'), lambda t: NOT list_contains({arr(X.STOP_WORDS)}, t)) AS tokens
  FROM items
),
token_rows AS (SELECT item_no, unnest(tokens) AS token FROM all_tokens),
slots AS (
  SELECT item_no, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM token_rows GROUP BY ALL
),
slot_maps AS (
  SELECT item_no, map_from_entries(list((slot, n))) AS m, sqrt(sum(n * n)::DOUBLE) AS norm FROM slots GROUP BY item_no
),
vectors AS MATERIALIZED (
  SELECT t.item_no, t.item_id, t.bucket, t.relevance_score, t.tokens,
    list_transform(range(64), lambda i: coalesce(m[i], 0)::DOUBLE / norm) AS vector
  FROM all_tokens t JOIN slot_maps USING (item_no)
),
item_terms AS (
  SELECT item_no, list(token ORDER BY place) AS top_terms FROM (
    SELECT item_no, token, row_number() OVER (PARTITION BY item_no ORDER BY count(*) DESC, token) AS place
    FROM token_rows GROUP BY item_no, token) WHERE place <= 8 GROUP BY item_no
)"""


def clusters(nodes: str, thresholds: list[float], prefix: str = "") -> str:
    """Components and cluster ids over ``nodes(item_no, item_id, bucket, relevance_score, vector)``."""
    p = prefix
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return rf"""
{p}thresholds(threshold) AS (VALUES {values}),
{p}pairs AS (
  SELECT a.item_no AS a, b.item_no AS b, floor(list_dot_product(a.vector, b.vector) * 1e9 + 0.5) / 1e9 AS cosine
  FROM {nodes} a JOIN {nodes} b ON a.bucket = b.bucket AND a.item_no <> b.item_no
),
{p}edges AS MATERIALIZED (SELECT threshold, a, b FROM {p}pairs JOIN {p}thresholds ON cosine >= threshold),
{p}comps(threshold, item_no, comp) USING KEY (threshold, item_no) AS (
  SELECT threshold, item_no, item_no FROM {nodes}, {p}thresholds
  UNION
  SELECT e.threshold, e.b, min(c.comp) FROM {p}comps c
    JOIN {p}edges e ON e.threshold = c.threshold AND e.a = c.item_no
    JOIN recurring.{p}comps r ON r.threshold = e.threshold AND r.item_no = e.b
  WHERE c.comp < r.comp GROUP BY e.threshold, e.b
),
{p}placed AS (SELECT c.threshold, c.comp, n.* FROM {p}comps c JOIN {nodes} n USING (item_no)),
{p}comp_ranks AS (
  SELECT threshold, bucket, comp,
    row_number() OVER (PARTITION BY threshold, bucket ORDER BY max(relevance_score) DESC, min(item_id)) AS cluster_index,
    count(*) OVER (PARTITION BY threshold, bucket) AS n_clusters
  FROM {p}placed GROUP BY threshold, bucket, comp
),
{p}members AS MATERIALIZED (
  SELECT p.threshold, p.bucket, r.cluster_index, 'cluster-' || p.bucket
      || CASE WHEN n_clusters = 1 THEN '' ELSE '-' || r.cluster_index END AS cluster_id,
    p.item_no, p.item_id, p.relevance_score
  FROM {p}placed p JOIN {p}comp_ranks r USING (threshold, bucket, comp)
)"""


LABEL_CASE = " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in X.BUCKET_LABELS.items())
OPPORTUNITY_CASE = " ".join(f"WHEN {lit(c)} THEN {lit(t)}" for c, t in X.BUCKET_OPPORTUNITIES.items())

ROLLUP = rf"""
details AS (
  SELECT m.threshold, m.cluster_index, m.cluster_id, i.*,
    row_number() OVER (PARTITION BY m.threshold, m.cluster_id ORDER BY i.relevance_score DESC, i.item_id) AS place
  FROM members m JOIN items i USING (item_id)
),
mixes AS (
  SELECT threshold, cluster_id, list(source_type || '=' || n ORDER BY source_type) AS source_mix FROM (
    SELECT threshold, cluster_id, source_type, count(*) AS n FROM details GROUP BY ALL) GROUP BY ALL
),
cluster_token_ranks AS (
  SELECT m.threshold, m.cluster_id, t.token,
    row_number() OVER (PARTITION BY m.threshold, m.cluster_id ORDER BY count(*) DESC, t.token) AS place
  FROM members m JOIN token_rows t USING (item_no) GROUP BY m.threshold, m.cluster_id, t.token
),
cluster_terms AS (
  SELECT threshold, cluster_id, list(token ORDER BY place) AS top_terms FROM cluster_token_ranks WHERE place <= 8 GROUP BY ALL
),
sums AS (
  SELECT threshold, bucket, cluster_index, cluster_id, count(*) AS item_count, sum(relevance_score) AS total,
    max(relevance_score) AS max_relevance_score, min(batch_index) AS batch_index,
    sum(('0x' || substr(sha256(concat_ws('|', item_id, source_id, title, clean_text, relevance_score::VARCHAR)), 1, 15))::BIGINT::HUGEINT) AS hash_sum,
    list(item_id ORDER BY place) FILTER (place <= 5) AS rep_items,
    list(source_id ORDER BY place) FILTER (place <= 5) AS rep_sources,
    list({cut('clean_text', 220, trim=False)} ORDER BY place) FILTER (place <= 5) AS excerpts
  FROM details GROUP BY threshold, bucket, cluster_index, cluster_id
),
rollup_rows AS MATERIALIZED (
  SELECT s.*, x.source_mix, t.top_terms, (total * 200 + item_count) // (item_count * 2) / 100.0 AS average_relevance_score,
    CASE bucket {LABEL_CASE} ELSE bucket END AS label, CASE bucket {OPPORTUNITY_CASE} ELSE '' END AS product_opportunity,
    sha256(concat_ws(chr(10), s.cluster_id, item_count::VARCHAR, hash_sum::VARCHAR)) AS input_hash
  FROM sums s JOIN mixes x USING (threshold, cluster_id) LEFT JOIN cluster_terms t USING (threshold, cluster_id)
)"""


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0::DOUBLE ELSE (({top}) * 20000 + ({bottom})) // (({bottom}) * 2) / 10000.0 END"


def metrics(labelled: str, prefix: str = "") -> str:
    """Pair counts and metrics, by forming the pairs, over ``labelled(threshold, source_id, gold, predicted)``."""
    p = prefix
    return rf"""
{p}pair_rows AS (
  SELECT a.threshold, a.gold = b.gold AS g, a.predicted = b.predicted AS p
  FROM {labelled} a JOIN {labelled} b ON a.threshold = b.threshold AND a.source_id < b.source_id
),
{p}pair_sums AS (
  SELECT threshold, count(*) AS pair_count, count(*) FILTER (g) AS gold_positive_pairs,
    count(*) FILTER (p) AS predicted_positive_pairs, count(*) FILTER (g AND p) AS true_positive_pairs
  FROM {p}pair_rows GROUP BY ALL
),
{p}metrics AS (
  SELECT *, {ratio('true_positive_pairs', 'predicted_positive_pairs')} AS pairwise_precision,
    {ratio('true_positive_pairs', 'gold_positive_pairs')} AS pairwise_recall,
    {ratio('2 * true_positive_pairs', 'predicted_positive_pairs + gold_positive_pairs')} AS pairwise_f1,
    (SELECT count(*) FROM {labelled} l WHERE l.threshold = s.threshold) AS labeled_item_count
  FROM {p}pair_sums s
)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
