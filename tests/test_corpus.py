import re

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell import catalog
from driftwell.operators import generation as G
from driftwell.operators.quality import row_violations, violations
from driftwell.plans import corpus as K
from driftwell.sources import io as S

SF = "/root/testdata/sf0.01"


SIZE = (20, 10)


@pytest.fixture(scope="module")
def made(spark):
    articles = K.example_articles(spark, SF).filter("key < 'part_000100'")
    return K.corpus(articles, K.example_changes(articles), 7).cache()


def test_a_generated_corpus_breaks_no_rule(spark, made):
    assert made.count() == 2000
    found = {r.rule: r.violations for r in K.report(made, *SIZE).collect()}
    assert len(found) >= 60 and {k for k, n in found.items() if n} == set()
    assert {r.rule for r in violations(S.ticket_violations(made)).filter("violations > 0").collect()} == set()


def test_lineage_and_drift(made):
    r = made.filter("is_changed_answer_near_duplicate and quarter = 'Q3' and difficulty = 'hard'").first()
    assert r.near_duplicate_of == r.id.replace("Q3", "Q2") and r.similar_question_ids[0] == r.near_duplicate_of
    assert r.drift.current_rule != r.drift.previous_rule and r.gold_answer.startswith(r.drift.current_rule) and r.profile_answers.intern.answer == r.drift.previous_gold_answer
    later = made.filter(F.col("id") == r.id.replace("Q3", "Q4")).first()
    assert later.gold_answer == r.gold_answer and not later.is_changed_answer_near_duplicate


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("ids are unique", {"id": "case when quarter = 'Q2' then 'SX-Q2-BIL-001' else id end"}),
        ("questions ask", {"question": "replace(question, '?', '!')"}),
        ("stable answers stay", {"gold_answer": "case when quarter = 'Q4' then concat(gold_answer, ' now') else gold_answer end"}),
        ("sources exist", {"near_duplicate_of": "concat(near_duplicate_of, 'x')"}),
        ("the intern knows easy, stable tickets alone", {"is_changed_answer_near_duplicate": "not is_changed_answer_near_duplicate"}),
        ("anchors name the policy", {"policy_key": "concat(policy_key, 'x')"}),
    ],
)
def test_rules_notice(made, rule, change):
    broken = made
    for name, sql in change.items():
        broken = broken.withColumn(name, F.expr(sql))
    assert not K.rules(broken, *SIZE)[rule].isEmpty() and K.rules(made, *SIZE)[rule].isEmpty()


#: A change of one ticket, or of all in a quarter, for each rule of single tickets.
BROKEN = {
    "ids follow the pattern": ("id", "'q1-1'"),
    "ids name their quarter": ("id", "replace(id, '-Q', '-R')"),
    "ids name their category": ("id", "replace(id, 'BIL', 'XXX')"),
    "quarters are known": ("quarter", "'Q9'"),
    "difficulties are known": ("difficulty", "'odd'"),
    "policies name their category": ("policy_key", "'x'"),
    "questions ask": ("question", "'" + "no question is put here at all. " * 2 + "'"),
    "questions are long enough": ("question", "'So?'"),
    "questions leave no mark open": ("question", "concat(question, '{q}')"),
    "titles are given": ("article_title", "' '"),
    "answers are given": ("gold_answer", "''"),
    "sequence numbers are positive": ("sequence_in_quarter", "0"),
    "the first quarter has no drift": ("quarter", "'Q1'"),
    "drift records are where drift is": ("drift", "null"),
    "sources are where drift is": ("near_duplicate_of", "null"),
    "sources differ from the ticket": ("near_duplicate_of", "id"),
    "sources share the ticket's number": ("near_duplicate_of", "concat(near_duplicate_of, '1')"),
    "sources come first among the relatives": ("similar_question_ids", "reverse(similar_question_ids)"),
    "rules of a drift differ": ("drift.previous_rule", "drift.current_rule"),
    "rules of a drift differ in words, not only in numbers": ("drift.previous_rule", "concat(drift.current_rule, ' 12')"),
    "answers of a drift differ": ("drift.previous_gold_answer", "drift.current_gold_answer"),
    "answers of a drift state its rules": ("drift.previous_gold_answer", "'x'"),
    "the current answer of a drift is gold": ("gold_answer", "'x'"),
    "drifts change two dimensions": ("drift.change_dimensions", "array('rule')"),
    "dimensions of a drift are distinct": ("drift.change_dimensions", "array('rule', 'rule')"),
    "drifts are introduced in their quarter": ("drift.introduced_in", "'Q1'"),
    "drifts name their policy": ("drift.changed_article", "'x'"),
    "drifts are of the kind that is real": ("drift.type", "'virtual'"),
    "the trusted answer is gold": ("profile_answers.ceo.answer", "'x'"),
    "out of domain is wrong": ("profile_answers.domain_expert_out_of_domain.answer", "gold_answer"),
    "errors out of domain are named": ("profile_answers.domain_expert_out_of_domain.error_type", "null"),
    "the intern knows easy, stable tickets alone": ("profile_answers.intern.is_correct", "true"),
    "the intern's answer is gold where known": ("profile_answers.intern.answer", "gold_answer"),
    "the intern's errors are named": ("profile_answers.intern.error_type", "null"),
    "the intern's stale answers are the drift's": ("profile_answers.intern.answer", "'x'"),
    "all profiles answer": ("profile_answers.ceo.answer", "null"),
    "siblings are listed": ("similar_question_ids", "slice(similar_question_ids, 1, 2)"),
    "siblings are listed once": ("similar_question_ids", "array_repeat(near_duplicate_of, 5)"),
    "a ticket is not its own sibling": ("similar_question_ids", "array_append(similar_question_ids, id)"),
    "anchors name the quarter's document": ("documentation_anchor", "replace(documentation_anchor, 'Q', 'R')"),
    "anchors name the policy": ("documentation_anchor", "concat(documentation_anchor, 'x')"),
    "nominal tickets need no abstention": ("requires_model_abstention", "true"),
}


def test_each_rule_of_single_tickets_notices_its_break(spark, made):
    assert set(BROKEN) == set(K.row_rules())
    one = made.filter("is_changed_answer_near_duplicate and category = 'billing' and difficulty = 'hard' and quarter = 'Q3'").limit(1).cache()
    assert one.count() == 1
    for rule, (column, sql) in BROKEN.items():
        top, *rest = column.split(".")
        value = F.expr(sql)
        broken = one.withColumn(top, value if not rest else F.col(top).withField(".".join(rest), value))
        found = {r.rule: r.violations for r in row_violations(broken, {rule: K.row_rules()[rule]}).collect()}
        assert found == {rule: 1}, rule
    assert row_violations(one, K.row_rules()).filter("violations > 0").isEmpty()


def test_abstention_split(spark, made):
    topics = spark.createDataFrame([(f"topic {i:02d}", f"What about unknown thing {i}?") for i in range(50)], "topic string, question string")
    rows = K.extra(topics, ["billing", "integrations", "onboarding", "permissions", "reporting"], 3)
    assert {r.rule: r.violations for r in violations(K.extra_rules(rows, made)).collect() if r.violations} == {}
    assert {r.rule for r in violations(K.extra_rules(rows.withColumn("requires_model_abstention", F.lit(False)), made)).filter("violations > 0").collect()} == {"extra requires abstention"}


def test_answer_keys_of_numbers_beyond_six_digits_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE ((p_partkey * 7919 + 999990)::BIGINT AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet') TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = {tuple(r) for r in catalog.queries()["answer_template"](spark, str(tmp_path)).select("p_partkey", "key").collect()}
    want = set(con.sql(f"SELECT p_partkey, key FROM ({catalog.oracle_sql()['answer_template']})").fetchall())
    assert got == want and max(k for k, _ in want) > 1_000_000


def test_a_quarters_order_is_sorted_in_ranges_of_keys(spark):
    articles = K.example_articles(spark, SF).filter("key < 'part_000100'")
    tickets = K.corpus(articles, K.example_changes(articles), 7)
    plan = tickets._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(quarter#\d+, _range#", plan) and not re.search(r"windowspecdefinition\(quarter#\d+, (?!_range#)", plan)
    places = tickets.select("quarter", "shuffled_order", "id", G.shuffle_key(F.pmod(F.xxhash64("id"), F.lit(1 << 31)), 7).alias("key")).collect()
    for q in K.PERIODS:
        rows = sorted((r for r in places if r.quarter == q), key=lambda r: (r.key, r.id))
        assert [r.shuffled_order for r in rows] == list(range(1, 501))
