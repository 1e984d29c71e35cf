"""Small cases with known results, one group per operator family."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from entityops.operators import adjudicate as A
from entityops.operators import audit, corpus, match, project, resolve, rules as R, trust, usage
from entityops.plans import jobs
from entityops.sources import configs, feedback, keyed, uploads

SLOT3 = "taxInformation.taxIdentificationNumbers.2.taxIdentificationNumber"
SLOT4 = "taxInformation.taxIdentificationNumbers.3.taxIdentificationNumber"


# --- rules -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "op, value, literals, expected",
    [
        ("equals", "x", [], False), ("notEquals", None, ["x"], True), ("notIn", None, ["x"], True), ("in", "b", ["a", "b"], True), ("eqIgnoreCase", "AbC", ["aBc"], True),
        ("gt", "10", ["9"], True), ("gt", "2024-02-01", ["2024-01-31"], True), ("gt", "x", ["1"], False), ("lte", "abc", ["2024-01-01"], False),
        ("matches", "xx12", [r"\d+"], True), ("lengthEq", None, ["0"], True), ("lengthGte", "abc", ["3"], True), ("dateBefore", "2024-01-01T05:00:00Z", ["2024-01-02"], True),
        ("dateAfter", "junk", ["2024-01-02"], False), ("dateWithinDays", "2024-01-05", ["4"], True), ("dateWithinDays", "2024-01-06", ["4"], False), ("dateWithinDays", "2024-01-05", ["x"], False),
        ("exists", " \t", [], False), ("isBlank", "", [], True), ("startsWith", "Abc", ["ab"], False), ("endsWith", "abc", ["bc"], True), ("contains", "abc", ["b"], True),
    ],
)
def test_predicates(one, op, value, literals, expected):
    as_of = F.lit("2024-01-01").cast("date")
    assert one({"a": value}, R.predicate(op, F.col("a"), ST.StringType(), literals, as_of)) is expected


def test_predicates_on_typed_values(one):
    assert one({"a": False}, R.predicate("lengthEq", F.col("a"), ST.BooleanType(), ["0"])) is True
    assert one({"a": 0}, R.predicate("lengthEq", F.col("a"), ST.LongType(), ["0"])) is True
    assert one({"a": True}, R.predicate("equals", F.col("a"), ST.BooleanType(), ["True"])) is True
    with pytest.raises(ValueError):
        R.predicate("soundsLike", F.col("a"), ST.StringType())
    with pytest.raises(ValueError):
        R.Condition("f", "soundsLike")


def test_last_baseline_wins_and_actions_grow(spark):
    records = spark.createDataFrame([(1, "IN", None, None), (2, "US", "x", None)], "id int, country string, pan string, ssn string")
    make = R.Dependency("conditional", (R.Condition("country", "equals", ("IN",), "makeRequired", ("pan",)),))
    rules = [R.Rule("pan", "a", True, True, "^A"), R.Rule("pan", "b", False, True, "^B"), R.Rule("country", "c", dependencies=(make, R.Dependency("atLeastOne", members=("ssn", "pan"))))]
    rows = {(r.id, r.path): r for r in R.evaluate_rules(records, rules, ["id"]).collect()}
    assert rows[1, "pan"].is_required and rows[1, "pan"].rule_ids == ["b", "c"]
    assert not rows[2, "pan"].is_required and rows[2, "pan"].regex_pattern == "^B"
    assert rows[2, "pan"].groups == {"atLeastOne": "pan|ssn"}
    found = {(r.id, r.path, r.violation) for r in R.apply_ruleset(records, rules, ["id"]).collect()}
    assert found == {(1, "pan", "required"), (2, "pan", "pattern")}
    assert [r.id for r in R.group_violations(records, rules, ["id"]).collect()] == [1]


def test_row_scope_sees_the_record_unless_bound(spark):
    rows = spark.createDataFrame([(1, "no", [("DE", "x"), ("FR", None)])], "id int, country string, banks array<struct<country string, iban string>>")
    dep = R.Dependency("conditional", (R.Condition("country", "equals", ("FR",), "makeRequired", ("iban",)),))
    rules = [R.Rule("iban", "r", scope="$.banks[*]", dependencies=(dep,))]
    plain = {r.path: r.is_required for r in R.evaluate_rules(rows, rules, ["id"]).collect()}
    bound = {r.path: r.is_required for r in R.evaluate_rules(rows, rules, ["id"], bind_rows=True).collect()}
    assert plain == {"banks.0.iban": False, "banks.1.iban": False}
    assert bound == {"banks.0.iban": False, "banks.1.iban": True}


def test_import_ids_and_hash(spark):
    rows = spark.createDataFrame(
        [("IN", "Tax & More", "PAN No.", None, 1, True), ("IN", "Tax & More", "PAN No.", None, 5000, True), ("IN", None, "--", "Bank A", 3, None)],
        "country string, group_label string, field_name string, scope_key string, ordinal long, isRequired boolean",
    )
    got = {r.ordinal: r for r in R.import_rules(rows).collect()}
    assert got[1].rule_id == "in.tax-more.pan-no" and got[5000].rule_id == "in.tax-more.pan-no-2" and got[3].rule_id == "in.field.field.bank-a"
    import hashlib

    body = json.dumps({"fieldGroupLabel": "Tax & More", "fieldName": "PAN No.", "isRequired": True}, sort_keys=True)
    assert got[1].content_hash == "sha256:" + hashlib.sha256(body.encode()).hexdigest()[:16]


def test_read_rulesets_from_files(spark, tmp_path):
    body = {
        "iso2CountryCode": "in",
        "rules": [{
            "fieldName": "pan", "isRequired": True,
            "dependencies": [{"ruleType": "conditional", "conditions": [{"fieldName": "x", "operator": "exists", "action": {"targetFields": ["pan", "y"], "actionType": "makeOptional"}}]}],
        }],
    }
    (tmp_path / "IN").mkdir()
    (tmp_path / "IN" / "ruleset.json").write_text(json.dumps(body, indent=1))
    rules, conditions, actions = configs.read_rulesets(spark, str(tmp_path))
    assert [tuple(r) for r in rules.select("country", "field_name", "is_required").collect()] == [("IN", "pan", True)]
    assert conditions.count() == 1 and sorted(r.target_field for r in actions.collect()) == ["pan", "y"]
    (rule,) = configs.load_rules(spark, str(tmp_path), "IN")
    assert rule.dependencies[0].conditions[0].targets == ("pan", "y")
    with pytest.raises(ValueError):
        configs.load_rules(spark, str(tmp_path), "IN", limit=0)


def test_read_playbooks_from_files(spark, tmp_path):
    body = {"countryCode": "in", "bindings": [{"logicalFieldId": "pan", "label": "PAN", "bind": {"kind": "taxSlot", "taxTypeCode": "TAXNO3"}}], "documents": [{"docType": "IN_PAN_CARD"}], "connectors": [{"id": "a", "type": "in_pan_format"}]}
    (tmp_path / "IN.json").write_text(json.dumps(body))
    bindings, documents, connectors = configs.read_playbooks(spark, str(tmp_path))
    assert A.resolve_bindings(bindings).first().path == SLOT3
    assert documents.first().writable is True and connectors.first().type == "in_pan_format"


def test_cross_checks(spark):
    rows = [
        ("ok", " aabca1234f", "27aabca1234f1z5 ", "HDFC0001234", "mh", False), ("bad", "ZZZZZ9999Z", "27AABCA1234F1Z5", None, "KA", None),
        ("person", "AABPA1234F", None, "HDFCX001234", None, False),
    ]
    ids = spark.createDataFrame(rows, "id string, pan string, gstin string, ifsc string, region_code string, is_natural_person boolean")
    got = {(r.id, r.check_id): r.status for r in audit.cross_field_checks(ids, ["id"]).collect()}
    assert {v for (i, _), v in got.items() if i == "ok"} == {"pass"}
    assert got["bad", "gstin_contains_pan"] == "fail" and got["bad", "gstin_state_vs_address_region"] == "warn"
    assert ("bad", "ifsc_shape") not in got
    assert got["person", "ifsc_shape"] == "fail" and got["person", "pan_entity_type"] == "warn"


# --- adjudication ----------------------------------------------------------------------------

BINDINGS = [
    ("trading_name", "Trading name", "scalar", None, "tradingName", None, 0, None, None, 1),
    ("pan", "TIN/PAN", "taxSlot", "TAXNO3", None, None, 0, None, None, 2),
    ("gstin", "GSTIN", "taxSlot", "TAXNO4", None, None, 0, None, None, 3),
    ("bill_to_city", "City", "address", None, None, "cityName", 0, None, None, 4),
]
BINDING_DDL = "logical_id string, label string, kind string, tax_type_code string, form_path string, field string, index int, key string, needs_resolution string, ordinal int"
PATCH_DDL = "array<struct<path string, value string, label string, confidence double, pre_selected boolean, needs_resolution string, regex_ok boolean>>"


def run_bundle(spark, documents, **extra):
    rows = [
        ("b", doc_id, kind, None, f"{n:03d}", [(p, v, None, c, c >= 0.9, None, True) for p, v, c in patches])
        for n, (doc_id, kind, patches) in enumerate(documents)
    ]
    extractions = spark.createDataFrame(rows, f"bundle_id string, document_id string, doc_type string, effective_date date, ordinal string, patches {PATCH_DDL}")
    kinds = spark.createDataFrame([(k, True) for k in {d[1] for d in documents}], "doc_type string, writable boolean")
    master = extra.pop("master", None)
    if master is None:
        master = spark.createDataFrame([], "bundle_id string, path string, value string, value_type string")
    return jobs.adjudicate(extractions, spark.createDataFrame(BINDINGS, BINDING_DDL), kinds, {"gstin": "gstin", "pan": "pan"}, master, multi_source={"trading_name": 0.82}, **extra)


NAMES = [("p", "IN_PAN_CARD", [("tradingName", "ACME LOGISTICS", 0.92)]), ("g", "IN_GST_CERTIFICATE", [(SLOT4, "27AABCA1234F1Z5", 0.95), ("tradingName", "ACME LOGISTICS PVT LTD", 0.95)])]


def test_name_conflict_needs_a_steward(spark):
    out = run_bundle(spark, NAMES)
    assert [c.path for c in out.conflicts.collect()] == ["tradingName"]
    verdicts = {(v.path, v.action) for v in out.verdicts.collect()}
    assert verdicts == {("tradingName", "steward_required"), (SLOT4, "accept")}
    assert [(r.status, r.preferred_value) for r in out.freshness.collect()] == [("unknown_date", "ACME LOGISTICS PVT LTD")]
    assert {"observe", "rule", "compare", "recommend"} == {s.kind for s in out.trail.collect()}
    steps = sorted(s.step for s in out.trail.collect())
    assert steps == list(range(1, len(steps) + 1))
    assert "1 field(s) disagree." in out.summary.first().summary


def test_unit_scale_lets_close_names_through(spark):
    close = [("p", "IN_PAN_CARD", [("tradingName", "ACME LOGISTIC", 0.92)]), ("g", "IN_GST_CERTIFICATE", [("tradingName", "ACME LOGISTICS", 0.95)])]
    assert [v.action for v in run_bundle(spark, close, scale="unit").verdicts.collect()] == ["suggest"]
    assert [v.action for v in run_bundle(spark, close).verdicts.collect()] == ["steward_required"]


def test_singleton_and_embedded_checks(spark):
    two = run_bundle(spark, [("a", "IN_GST_CERTIFICATE", [(SLOT4, "27AABCA1234F1Z5", 0.95)]), ("b", "IN_GST_CERTIFICATE", [(SLOT4, "29AAACI4403L3ZI", 0.95)])])
    assert ("id_gstin_singleton", "fail") in {(c.check_id, c.status) for c in two.checks.collect()}
    assert not any(o.pre_selected for o in two.options.collect())
    mixed = run_bundle(spark, [("g", "IN_GST_CERTIFICATE", [(SLOT4, "27AABCA1234F1Z5", 0.95)]), ("p", "IN_PAN_CARD", [(SLOT3, "ZZZZZ9999Z", 0.95)])])
    assert ("cross_gstin_embeds_pan", "fail") in {(c.check_id, c.status) for c in mixed.checks.collect()}
    assert ("reject" in {v.action for v in mixed.verdicts.collect()}) is True


def test_master_comparison_and_auto_apply(spark):
    master = spark.createDataFrame([("b", "tradingName", "OTHER NAME", "string"), ("b", SLOT4, "27aabca 1234f1z5", "string")], "bundle_id string, path string, value string, value_type string")
    out = run_bundle(spark, NAMES[1:], master=master)
    assert [c.check_id for c in out.checks.collect()] == ["form_mismatch_tradingName"]
    applied = A.auto_apply(out.verdicts, out.options, A.superseded_options(out.options, out.freshness))
    assert sorted(r.path for r in applied.collect()) == [SLOT4, "tradingName"]


def test_least_similar_pair_equals_all_pairs(spark):
    import itertools
    import random

    from entityops.functions.text import _similarity

    rng = random.Random(4)
    names = {g: ["".join(rng.choices("abcd", k=rng.randint(1, n))) + " " + "".join(rng.choices("ab", k=3)) for _ in range(n * 3)] for g, n in enumerate((1, 2, 4, 9, 14))}
    names[9] = ["steel works north " + "".join(rng.choices("xyz", k=3)) for _ in range(30)]  # all alike
    names[10] = ["single", " single "]
    rows = [(str(g), "legal_name", v) for g, group in names.items() for v in group + group[:1]] + [("0", "other", "x"), ("0", "legal_name", " ")]
    got = {r.bundle_id: r for r in A.min_pairwise_similarity(spark.createDataFrame(rows, "bundle_id string, logical_id string, value string"), {"legal_name": 0.82}).collect()}

    def ratio(a, b):
        a, b = (" ".join(sorted(x.split())) for x in (a, b))
        return _similarity(a, b) / 100

    expected = {str(g): min(ratio(a, b) for a, b in itertools.combinations(set(group), 2)) for g, group in names.items() if len({v.strip() for v in group}) > 1}
    assert set(got) == set(expected)
    for g, lowest in expected.items():
        assert abs(got[g].min_ratio - lowest) < 1e-9 and got[g].status == ("warn" if lowest < 0.82 else "pass")


def test_pairwise_similarity_agrees_with_brute_force(spark):
    import itertools
    import random

    from entityops.functions.text import _similarity

    rng = random.Random(3)
    groups = {}
    for g in range(25):
        seed = "".join(rng.choice("abcdefgh") for _ in range(14))
        values = {seed}
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(14)
            values.add(seed[:at] + rng.choice("xyz") * rng.randint(0, 3) + seed[at + 1 :])
        groups[str(g)] = values
    rows = [(g, "legal_name", v) for g, vs in groups.items() for v in vs for _ in range(2)]
    options = spark.createDataFrame(rows, "bundle_id string, logical_id string, value string")
    got = {r.bundle_id: r.status for r in A.min_pairwise_similarity(options, {"legal_name": 0.82}).collect()}
    want = {
        g: "warn" if min(_similarity(a, b) for a, b in itertools.combinations(vs, 2)) / 100 < 0.82 else "pass" for g, vs in groups.items() if len(vs) > 1
    }
    assert got == want and set(want.values()) == {"warn", "pass"}


def test_address_without_stored_record_prefers_the_operational_one(spark):
    rows = [
        ("b", "gst", "principal_pob", "61-B, VELAMPALAYAM, Tiruppur, 641652", 0.95, 1, "641652", "Tiruppur", None, None, None),
        ("b", "proof", "operational", "D.NO.61B, VELAMPALAYAM MAIN ROAD, Avinashi, 641652", 0.98, 2, "641652", "Avinashi", None, "VELAMPALAYAM MAIN ROAD", None),
    ]
    names = "postalCode string, cityName string, district string, streetName string, buildingName string"
    candidates = spark.createDataFrame(rows, f"bundle_id string, candidate_key string, address_role string, full_text string, confidence double, ordinal int, {names}")
    empty = spark.createDataFrame([], f"bundle_id string, {names}")
    ranked = {r.candidate_key: r for r in A.rank_candidates(A.score_address_candidates(candidates, empty)).collect()}
    assert ranked["proof"].recommended and not ranked["gst"].recommended
    assert ranked["proof"].alignment_score == 0.993
    stored = spark.createDataFrame([("b", "641653", "Avinashi", None, None, None)], f"bundle_id string, {names}")
    near = {r.candidate_key: r for r in A.score_address_candidates(candidates, stored).collect()}
    assert near["proof"].matched_fields == "postalCode,cityName" and near["proof"].alignment_score == 1.0
    assert near["gst"].gaps == "cityName"


# --- matching and trust ----------------------------------------------------------------------


def test_city_reference(spark):
    cities = spark.createDataFrame(
        [(1, "Springfield", "GEO_IL", "IL", "IL"), (2, "Springfield", "GEO_MO", "MO", "MO"), (3, "New Delhi", "GEO_DL", "DL", "DL"), (4, "Mumbai", None, "MH", "MH")],
        "ordinal int, city_name string, code string, subdivision_code string, subdivision_name string",
    )
    asked = spark.createDataFrame(
        [(1, "Springfield", "mo", None), (2, "springfield ", None, None), (3, "Delhi", None, None), (4, "MUMBAI", "XX", None), (5, "Nowhere", None, None), (6, "D", None, "dl"), (7, "", None, None)],
        "id int, value string, region_code string, region_name string",
    )
    got = {r.id: (r.matched_code, r.match_score) for r in match.match_reference(asked, cities).collect()}
    assert got == {1: ("GEO_MO", 125), 2: ("GEO_IL", 100), 3: ("GEO_DL", 60), 4: ("Mumbai", 60), 5: (None, None), 6: ("GEO_DL", 70), 7: (None, None)}


def test_evidence_and_overall(spark):
    row = ("1", "SREEJA HOSIERIES", None, ["33AALCS3056Q1ZT"], "Tirupur", None, "641 652", "in", "SREEJA HOSIERIES PVT LTD", None, "33aalcs3056q1zt", "Tirupur", "Main st", "641-652", "IN")
    ddl = "id string, name string, legal_name string, tax_ids array<string>, city string, street string, postal_code string, country string, found_name string, found_legal_name string, found_tax_id string, found_city string, found_street string, found_postal_code string, found_country string"
    evidence = match.score_pairs(spark.createDataFrame([row], ddl), ["id"])
    got = {r.field: (r.score, r.status) for r in evidence.collect()}
    assert got == {"tradingName": (80, "partial"), "tax": (100, "match"), "city": (100, "match"), "street": (0, "unknown"), "postalCode": (100, "match"), "country": (100, "match")}
    overall = match.overall_weighted(evidence, ["id"]).first()
    assert (overall.score, overall.compared, overall.skipped) == (93, 5, 1)


def test_blend_raises_but_never_lowers(spark):
    evidence = spark.createDataFrame([("a", "IN001", "tradingName", 50, "partial"), ("a", "IN001", "street", 70, "partial"), ("b", "IN002", "tradingName", 0, "unknown")], "k string, candidate string, field string, score int, status string")
    similarity = spark.createDataFrame([("IN001", 95, 0, "n"), ("IN002", 99, None, "m")], "candidate string, name_score int, address_score int, note string")
    blended, overall = match.blend_semantic(evidence, similarity, ["k"], "candidate")
    assert {(r.k, r.field): (r.score, r.status) for r in blended.collect()} == {("a", "tradingName"): (95, "match"), ("a", "street"): (70, "partial"), ("b", "tradingName"): (0, "unknown")}
    assert {r.k: r.overall_score for r in overall.collect()} == {"a": 82, "b": 0}


def _brute_duplicates(rows, top=5):
    out = {}
    for rid, name, country, postal in rows:
        found = []
        for oid, oname, ocountry, opostal in rows:
            a, b = set(name.split()), set(oname.split())
            j = len(a & b) / len(a | b)
            if oid == rid or j < 0.5:
                continue
            named = round(j * 100)
            weight, total = 30, named * 30
            if country and ocountry:
                weight, total = weight + 5, total + (500 if country == ocountry else 0)
            if postal and opostal:
                weight, total = weight + 10, total + (1000 if postal == opostal else 0)
            found.append((-round(total / weight), oid))
        out[rid] = [oid for _, oid in sorted(found)[:top]]
    return {k: v for k, v in out.items() if v}


def test_duplicates_with_a_hot_group_of_copies(spark):
    import random

    rng = random.Random(5)
    rows = [(i, "acme trading house", "IN", "1") for i in range(40)]
    rows += [(100 + i, " ".join(rng.sample("acme trading house north south oil gas".split(), 3)), rng.choice(["IN", "US", ""]), rng.choice(["1", "2", ""])) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "record_id long, name string, country string, postal_code string")
    got = {}
    for r in match.duplicate_candidates(df).orderBy("record_id", "rank").collect():
        got.setdefault(r.record_id, []).append(r.candidate_id)
    assert got == _brute_duplicates(rows)


def _sources(spark, rows):
    return spark.createDataFrame(rows, "record_id string, source_id string, connector_id string, source_type string, mode string, authority double, ordinal int, completeness int, verdict string")


def _evidence(spark, rows):
    return spark.createDataFrame(rows, "record_id string, source_id string, field string, score int, status string")


def test_isolated_match_is_discounted(spark):
    sources = _sources(spark, [("r", "s", "in_gstin", "format_validator", "format_check", 1.0, 1, None, None)])
    scored = trust.source_scores(sources, _evidence(spark, [("r", "s", "tax", 100, "match"), ("r", "s", "country", 100, "match")]))
    found = trust.correlation(scored).first()
    assert (found.correlation_score, found.isolated) == (55, True)
    assert trust.trust_score(scored).first().trust_score == 60


def test_ordered_caps_and_boosts(spark):
    sources = _sources(spark, [
        ("r", "a", "bill_to_address", "format_validator", "format_check", 0.95, 1, 100, None), ("r", "b", "in_gstin_live", "government_registry", "live_registry", 1.0, 2, None, None),
        ("d", "a", "commercial_directory", "commercial_directory", "web_enrichment", 0.75, 1, None, "different"),
    ])
    evidence = _evidence(spark, [("r", "b", "tradingName", 90, "match"), ("r", "b", "tax", 100, "match"), ("r", "b", "city", 80, "partial"), ("d", "a", "tradingName", 95, "match")])
    got = {r.record_id: r for r in trust.trust_score(trust.source_scores(sources, evidence)).collect()}
    assert (got["r"].trust_score, got["r"].trust_band) == (100, "high")  # 94 + 5 + 5, capped
    assert (got["d"].trust_score, got["d"].trust_band) == (30, "low")


def test_address_review_formats(spark):
    rows = [("in", "12", "Road", None, "Pune", "411001", "IN", "IN", "27AAPFU0939F1ZV"), ("gb", "1", "High St", None, "London", "sw1a  1aa", None, "GB", None), ("none", None, " ", None, None, None, None, "IN", "bad")]
    df = spark.createDataFrame(rows, "record_id string, street_number string, street_name string, building_name string, city string, postal_code string, address_country string, country string, tax_id string")
    got = {r.record_id: (r.completeness, r.notes) for r in trust.address_completeness(df, ["record_id"]).collect()}
    assert got == {"in": (100, ""), "gb": (100, ""), "none": (25, "street missing,incomplete,no content")}


def test_format_hits(spark):
    df = spark.createDataFrame([("1", "IN", " 27aapfu0939f1zv "), ("2", "IN", "27AAPFU0939F1ZA"), ("3", "IN", "AABCA1234F"), ("4", "GB", "sc 123456")], "record_id string, country string, tax_id string")
    assert {r.record_id: r.connector_id for r in trust.format_hits(df).collect()} == {"1": "in_gstin", "3": "in_pan", "4": "gb_company_number"}


# --- corpus ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, expected",
    [
        ("FORM GST REG-06 ... GSTIN 27AABCA1234F1Z5 Registration Certificate", "IN_GST_CERTIFICATE"), ("INCOME TAX DEPARTMENT Permanent Account Number AABCA1234F", "IN_PAN_CARD"),
        ("Account Number 000123456789 IFSC HDFC0001234 MICR 400240001", "IN_CANCELLED_CHEQUE"), ("DEED OF PARTNERSHIP between partners dated 2020", "IN_DEED_OF_PARTNERSHIP"),
        ("Importer Exporter Code IEC certificate issued by DGFT", "IN_IEC_CERTIFICATE"), ("some unrelated invoice text", None),
    ],
)
def test_document_types(spark, text, expected):
    row = corpus.classify_corpus(spark.createDataFrame([(text,)], "text string")).first()
    assert row.doc_type == expected and row.ambiguous is (expected is None)


def test_file_name_hint_gives_way_to_national_id(spark):
    df = spark.createDataFrame([("AADHAAR card", "x_PAN-aadhaar_card.pdf", None), ("nothing", "tax_mto-iata_1.pdf", None), ("nothing", "a.pdf", "in_special")], "text string, f string, h string")
    got = [(r.doc_type, r.confidence, r.ambiguous) for r in corpus.classify_corpus(df, filename="f", hint="h").collect()]
    assert got == [("IN_ADDRESS_PROOF", 0.8, False), ("IN_MTO_IATA_CHA_CERTIFICATE", 0.8, False), ("IN_SPECIAL", 0.85, False)]


def test_page_signals(spark):
    page = """<html><title>T &amp; Co</title><meta property='og:site_name' content='Site'><script type="application/ld+json">{"@type":"LocalBusiness","name":"Shop","address":{"addressLocality":"Pune"}}</script>"""
    df = spark.createDataFrame([(1, " shop.example.com/x ", page), (2, "http://a.example", "<p>none</p>"), (3, "https://b.example", "x" * 100_000 + "<TITLE>\n Late   one </TITLE>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in corpus.page_signals(df).collect()}
    assert set(got) == {1, 3} and got[3].name == "Late one"
    assert (got[1].name, got[1].city, got[1].title, got[1].host, got[1].url) == ("Shop", "Pune", "T & Co", "shop.example.com", "https://shop.example.com/x")


@pytest.mark.parametrize(
    "query, expected",
    [
        ("erp code 12345", {"intent": "code_lookup", "code": "0000012345", "code_type": "ERP_VNDR_CD", "confidence": "high", "immediate": True}),
        ("sap 40021 code", {"code": "0000040021", "code_type": "S4_BP_VNDR_CD"}), ("1234567", {"code": "1234567", "confidence": "medium", "immediate": True}),
        ("IN000070343", {"intent": "code_lookup", "code": "IN000070343"}), ("all vendors in India", {"country": "IN", "trading_name": None, "confidence": "high"}),
        ("pending approval vendors in workflow Brazil", {"country": "BR", "in_workflow": True, "vendor_status": "PENDING", "has_draft": True}),
        ("inactive vendors Mumbai India", {"vendor_status": "INACTIVE", "city": "Mumbai", "country": "IN"}), ("tax id 27AABCA1234F1Z5", {"tax_id": "27AABCA1234F1Z5", "immediate": False}),
        ("Acme Shipping in Germany", {"trading_name": "Acme Shipping", "country": "DE", "immediate": True}), ("acme", {"trading_name": "acme", "confidence": "low", "immediate": False}),
        ("sao paulo", {"intent": "attribute_search", "city": "Sao Paulo", "trading_name": "paulo"}), ("new delhi traders india", {"city": "Delhi", "trading_name": "new traders"}), ("  ", {"intent": None}),
    ],
)
def test_query_intent(spark, query, expected):
    row = corpus.tag_query_intent(spark.createDataFrame([(query,)], "query string")).first().asDict()
    assert {k: row[k] for k in expected} == expected


# --- projections, resolution, sources --------------------------------------------------------


def test_blocking_request(spark):
    tax = "array<struct<number string, country string, type_code string, slot string>>"
    df = spark.createDataFrame([(1, " Acme ", "IN", "Main St", None, "Mumbai", [(" ", None, None, None), ("ABCDE1234F", "", None, None)]), (2, None, "IN", None, None, "DUTKZXLEQ9F1L", [])], f"id int, name string, country string, street string, postal_code string, city string, tax {tax}")
    request, taxes = match.blocking_request(df, ["id"])
    assert {r.id: (r.name, r.city) for r in request.collect()} == {1: ("Acme", "Mumbai"), 2: ("", None)}
    assert [(r.number, r.country, r.slot) for r in taxes.collect()] == [("ABCDE1234F", "IN", "TAXNO2")]


def test_stage_gate_and_remap(spark):
    records = spark.createDataFrame([(1, ""), (2, "Acme"), (3, "")], "id int, name string")
    resolved = spark.createDataFrame([(1, "registry", 0.9), (2, "registry", 0.84)], "id int, stage string, confidence double")
    got = {r.id: (r.run, r.reason) for r in project.stage_gate(records, resolved, {"registry": F.col("name") == ""}, "id").collect()}
    assert got == {1: (False, "already_resolved"), 2: (True, None), 3: (False, "input_missing")}
    paths = spark.createDataFrame([("vendorBankAccounts.0.ifsc",)], "path string")
    assert project.remap_paths(paths, "edit_bank_accounts").first().path == "bankAccounts.0.ifsc"
    assert project.remap_paths(paths, None).first().path == "vendorBankAccounts.0.ifsc"


def test_apply_patches_replaces_what_lies_below(spark):
    stored = spark.createDataFrame([("r", "a", "1"), ("r", "b.c", "2"), ("r", "b.d.e", "3"), ("s", "b.c", "4")], "record_id string, path string, value string")
    patches = spark.createDataFrame([("r", "b", "x", 1), ("r", "n.m", "y", 2), ("r", "n.m", "z", 3)], "record_id string, path string, value string, ordinal int")
    got = sorted(tuple(r) for r in resolve.apply_patches(stored, patches).select("record_id", "path", "value").collect())
    assert got == [("r", "a", "1"), ("r", "b", "x"), ("r", "n.m", "z"), ("s", "b.c", "4")]
    assert resolve.read_value(stored, "a").first().value == "1"


def test_uploads_from_files(spark, tmp_path):
    cases = {"a.pdf": b"%PDF-1.4", "b.jpg": b"\xff\xd8\xff\xe0", "c.png": b"\x89PNG\r\n\x1a\n..", "d.docx": b"PK\x03\x04" + b"0" * 50, "e.txt": b"not a real document", "f.bin": b"", "g.pdf": b"%PDF-" + b"0" * 200}
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body)
    manifest = spark.createDataFrame([(f"file:{tmp_path}/{name}",) for name in cases], "path string")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.mime) for r in uploads.upload_scan(spark, str(tmp_path), max_bytes=100, manifest=manifest).collect()}
    assert "f.bin" not in {r.path.rsplit("/", 1)[1] for r in uploads.upload_scan(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.pdf": 200, "b.jpg": 200, "c.png": 200, "d.docx": 200, "e.txt": 415, "f.bin": 400, "g.pdf": 413}
    assert got["a.pdf"][1] == "application/pdf"


def test_feedback_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    entries = spark.createDataFrame([(f"review-{i}", "not_helpful", "IN", ["in_gstin"]) for i in range(10)], "reviewId string, rating string, countryCode string, connectorIds array<string>")
    rows = feedback.feedback_rows(entries, ["reviewId"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    feedback.append_feedback(rows, path)
    feedback.append_feedback(rows.limit(1), path)
    (tmp_path / "log" / "part-broken.json").write_text("{broken\n\n")
    stored = feedback.read_feedback(spark, path)
    assert stored.count() == 11 and stored.select("feedbackId").distinct().count() == 10
    log = stored.select(F.col("countryCode").alias("country"), "rating", F.col("connectorIds").alias("connector_ids"), F.col("createdAt").alias("ts"), F.col("feedbackId").alias("ordinal"))
    connectors = spark.createDataFrame([("IN", "in_gstin", 1)], "country string, connector string, ordinal int")
    assert [(r.subject, r.percent) for r in usage.feedback_hints(log, connectors).orderBy("hint_no").collect()] == [("in_gstin", 100), ("country", 100)]


def test_access_summary(spark):
    rows = [("anil.k@example.com", "Requester", "country:country_INDIA_IN", ["can_write"], 1), ("anil.k@example.com", "Other", "country:country_BANGLADESH_BG", ["can_write", "can_edit"], 2), ("user:b", None, "IN", None, 3)]
    users, items = usage.access_summary(spark.createDataFrame(rows, "user_name string, relation string, object_id string, policy_conditions array<string>, ordinal int"))
    assert {r.user_name: (r.relation, r.countries) for r in users.collect()} == {"user:anil.k@example.com": ("Requester", "BG,IN"), "user:b": ("", "")}
    assert sorted(r.item for r in items.where("kind = 'condition'").collect()) == ["can_edit", "can_write"]


def test_snapshot_reader(spark, tmp_path):
    path = str(tmp_path / "cities")
    spark.createDataFrame([("IN", "Pune"), ("US", "Ames")], "country string, city_name string").write.partitionBy("country").parquet(path)
    assert [r.city_name for r in configs.read_snapshot(spark, path, " in ").collect()] == ["Pune"]


def test_exact_duplicates_keep_every_copy(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"text {i}") for i in range(60)], "id long, body string")
    got = {r.id: r.first_id for r in keyed.exact_duplicates(df, "id", "body").collect()}
    assert got == {i: 1 if i % 3 else i for i in range(60)}


def test_resolution_stays_in_the_country_of_the_option(spark):
    options = spark.createDataFrame(
        [(1, "postalAddresses.0.cityName", "paris", "cityCode", 1, "us"), (2, "postalAddresses.0.cityName", "Paris", "cityCode", 1, "FR"), (3, "postalAddresses.0.cityName", "Paris", "cityCode", 1, "IN")]
        + [(1, "vendorBankAccounts.0.ifsc", "b1", "bankingInstitutionCode", 2, "us"), (2, "vendorBankAccounts.0.ifsc", "B1", "bankingInstitutionCode", 2, "FR"), (3, "vendorBankAccounts.0.ifsc", "B1", "bankingInstitutionCode", 2, "IN")],
        "record_id int, path string, value string, needs_resolution string, ordinal int, country string",
    ).withColumn("label", F.col("path"))
    cities = spark.createDataFrame(
        [(1, "Paris", "", "IDF", "Ile-de-France", "FR"), (2, "Paris", "", "TX", "Texas", "US")],
        "ordinal int, city_name string, code string, subdivision_code string, subdivision_name string, country string",
    )
    banks = spark.createDataFrame(
        [("B1", "B1", "Banque", False, 1, "FR", "SWFR", "Centre"), ("B1", "B1", "Bank", False, 2, "US", "SWUS", None)],
        "search_key string, code string, name string, deleted boolean, ordinal int, country string, swift_code string, branch_name string",
    )
    records = spark.createDataFrame([], "record_id int, path string, value string")
    applied, skipped = resolve.resolve_and_apply(options, cities, banks, records)
    got = {(r.record_id, r.path.split(".")[-1]): r.value for r in applied.collect()}
    assert {k: v for (i, k), v in got.items() if i == 1} == {
        "cityName": "Paris", "cityCode": "Paris", "regionCode": "TX", "regionName": "Texas", "bankingInstitutionCode": "B1", "bankName": "Bank", "swiftCode": "SWUS", "iso2CountryCode": "US",
    }
    assert {k: v for (i, k), v in got.items() if i == 2} == {
        "cityName": "Paris", "cityCode": "Paris", "regionCode": "IDF", "regionName": "Ile-de-France", "bankingInstitutionCode": "B1", "bankName": "Banque", "swiftCode": "SWFR", "bankBranchName": "Centre", "iso2CountryCode": "FR",
    }
    assert {k: v for (i, k), v in got.items() if i == 3} == {"cityName": "Paris"}
    assert sorted((r.record_id, r.reason) for r in skipped.collect()) == [(3, "city name applied only"), (3, "no bank match")]
    with pytest.raises(ValueError, match="country"):
        resolve.resolve_and_apply(options.drop("country"), cities, banks, records)
