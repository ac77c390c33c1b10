"""Keyword dictionaries: policy number to its words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Keywords = dict[int, list[str]]

# Dictionary for monthly keyword counting.
COUNTING: Keywords = {
    1: ["부동산 매매", "실거래가", "거래량", "매도자", "매수자", "매매가 상승", "시장 안정"],
    2: ["전세", "월세", "임대차", "보증금", "임대료", "임차인", "전월세 상한제", "계약갱신청구권"],
    3: ["LTV", "DTI", "DSR", "대출 한도", "주택담보대출", "금리", "대출 규제", "대출 완화"],
    4: ["종부세", "취득세", "재산세", "양도소득세", "보유세", "세율", "공시가격", "세제 개편"],
}

# Dictionary for the counts report and the fixed-vocabulary scores.
REPORTING: Keywords = {
    1: ["실거래가", "전매 제한", "경매", "주택 거래", "안정화 대책", "매각", "부동산 매매", "매매가", "매물", "매수", "매입",
        "투기지역", "실수요자", "주택구매", "거래절벽"],
    2: ["공공임대", "전월세 상한제", "금융규제", "디딤돌", "보증금", "임대차", "전세", "월세", "전세대출", "임차인", "주택담보",
        "LTV", "DTI", "DSR", "계약갱신"],
    3: ["분양가 상한", "주택공급", "택지개발촉진법", "과세", "분상", "재건축", "초과이익환수제", "재개", "재시공", "인허가", "조세",
        "양도세", "종합부동산세", "취득세", "부동산세제"],
}

# Dictionary for per-article scores.
SCORING: Keywords = {
    1: ["가격", "거래", "거래량", "경매", "계약", "고가", "매각", "매매", "매물", "매수", "매입", "시세", "시장", "실거", "실수요자",
        "주거", "주택", "집값", "부동산"],
    2: ["공공임대", "금리", "금융", "깡통", "디딤돌", "보증금", "임대", "임대인", "전세", "전셋값", "월세", "중도금", "취득세"],
    3: ["분양", "공급", "건설", "건축", "과세", "국토", "규제", "민간", "분상", "재건", "재건축", "재개", "재시공", "인허가", "신축",
        "조세", "택지", "토지", "양도세", "허가", "주택공급"],
}

# News sections with their ids.
SECTIONS = [
    ("부동산", "101", "260"),
    ("금융", "101", "259"),
    ("증권", "101", "258"),
    ("생활경제", "101", "310"),
    ("경제 일반", "101", "263"),
    ("행정", "100", "266"),
    ("정치일반", "100", "269"),
    ("산업/재계", "101", "261"),
    ("중기/벤처", "101", "771"),
    ("글로벌 경제", "101", "262"),
    ("대통령실", "100", "264"),
    ("국회/정당", "100", "265"),
    ("북한", "100", "268"),
    ("국방/외교", "100", "267"),
]


def all_words(keywords: Keywords) -> list[str]:
    return sorted({word for words in keywords.values() for word in words})


def keywords_df(spark: SparkSession, keywords: Keywords) -> DataFrame:
    """Dictionary as a table (policy, word). It is a local relation, so the planner knows its exact size."""
    pairs = sorted({(policy, word) for policy, words in keywords.items() for word in words})
    table = pa.table({
        "policy": pa.array([p for p, _ in pairs], pa.int32()),
        "word": pa.array([w for _, w in pairs], pa.string()),
    })
    return spark.createDataFrame(table)


def keywords_from_labels(labelled: DataFrame) -> DataFrame:
    """Labelled word list as a keyword table; a word may carry several labels."""
    return labelled.select(labelled.label.alias("policy"), "word").distinct()


def sections_df(spark: SparkSession, sections: list[tuple[str, str, str]] = SECTIONS) -> DataFrame:
    columns = list(zip(*sections, strict=True))
    return spark.createDataFrame(pa.table(dict(zip(("name", "section_id", "sub_section_id"), map(list, columns), strict=True))))
