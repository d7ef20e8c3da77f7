"""Fixed values.

Everything here is data that results depend on: grid sizes, rule thresholds, tariff rates,
time bands, the holiday calendar and the sentence formats of the briefing. They are stated
plainly because other values would give other results.
"""

from __future__ import annotations

# --- fixed values: grid -------------------------------------------------------------------
STEP_MINUTES = 15
STEPS_PER_HOUR = 4
STEPS_PER_DAY = 96
STEPS_PER_WEEK = 672

# --- fixed values: rule thresholds --------------------------------------------------------
DERIVED_ABS_TOLERANCE = 0.5 + 1e-9
DERIVED_MATCH_SHARE = 0.99
DERIVED_MIN_ROWS = 100
DERIVED_MIN_SHARE = 0.5
CALENDAR_MATCH_SHARE = 0.99
CALENDAR_KEYS = ("hour", "month", "dayofweek", "date")
INACTIVE_DAY_RATIO = 0.2
TEST_FRACTION = 0.3
DEFAULT_SPLIT_DATES = {2021: 20210725}
FORWARD_FOLDS = 4
FORWARD_FOLD_DAYS = 24
WINDOW_STEPS = 96
WINDOW_ROWS = 24
TRAIN_MONTHS = 3
FIT_SHARE = 0.85
SEEDS = (42, 2024, 7)
BLEND_DEFAULT = 0.5
MIN_TREE_ROWS = 1000
MIN_SEQUENCE_ROWS = 1500
MIN_ERROR_SAMPLES = 30
ERROR_QUANTILE = 0.9
FALLBACK_MARGIN_SHARE = 0.05
ALERT_LIMIT = 20
RECENT_VALUES = 8

# --- fixed values: headers of the usual source file, and the names used here --------------
SOURCE_COLUMNS = {
    "날짜": "dt", "시간": "hr", "15분": "q1", "30분": "q2", "45분": "q3", "60분": "q4",
    "평균": "mean4", "생산량": "production", "기온": "temp", "풍속": "wind", "습도": "humidity",
    "강수량": "rain", "전기요금(계절)": "season_price", "공장인원": "staff", "인건비": "wage",
}

# --- fixed values: model inputs -----------------------------------------------------------
TREE_FEATURES = (
    "kw_lag1", "kw_lag2", "kw_lag3", "kw_lag4", "kw_lag8", "kw_lag96", "lag16",
    "kw_d1", "kw_d2", "kw_roll4", "kw_roll16", "kw_std4", "delta_2h", "delta_4h",
    "mean_2h", "max_2h", "mean_4h", "max_4h",
    "hour", "quarter", "dow", "is_weekend", "is_day_shift", "tod_sin", "tod_cos",
)
WEATHER_LAGS = ("temp_lag4", "wind_lag4", "humidity_lag4", "rain_lag4")
SEQUENCE_CALENDAR = ("tod_sin", "tod_cos", "dow_sin", "dow_cos", "is_off", "days_since_active")

# --- fixed values: tariff (won per kWh, hours as half-open intervals) ---------------------
BASE_RATE_PER_KW = 7220.0
BILLING_PEAK_KW = 200.0
DAY_WAGE = 8720.0
NIGHT_MULTIPLIER = 1.5
NIGHT_START = 22
NIGHT_END = 6
UNIT_PRICE = 150.0
RATES = {
    "summer": {"off": 56.6, "mid": 109.5, "peak": 191.6},
    "spring_autumn": {"off": 56.6, "mid": 79.1, "peak": 109.8},
    "winter": {"off": 63.6, "mid": 109.7, "peak": 167.2},
}
TIME_BANDS = {
    "summer": {"off": [[23, 24], [0, 9]], "mid": [[9, 10], [12, 13], [17, 23]],
               "peak": [[10, 12], [13, 17]]},
    "spring_autumn": {"off": [[23, 24], [0, 9]], "mid": [[9, 10], [12, 13], [17, 23]],
                      "peak": [[10, 12], [13, 17]]},
    "winter": {"off": [[23, 24], [0, 9]], "mid": [[9, 10], [12, 17], [20, 22]],
               "peak": [[10, 12], [17, 20], [22, 23]]},
}
SUMMER_MONTHS = (6, 7, 8)
WINTER_MONTHS = (11, 12, 1, 2)

# --- fixed values: public holidays of Korea, 2021-2026 ------------------------------------
HOLIDAYS_TEXT = """
2021-01-01 신정
2021-02-11 설날 연휴
2021-02-12 설날 연휴
2021-02-13 설날 연휴
2021-03-01 삼일절
2021-05-05 어린이날
2021-05-19 부처님오신날
2021-06-06 현충일
2021-08-15 광복절
2021-08-16 광복절 대체공휴일
2021-09-20 추석 연휴
2021-09-21 추석 연휴
2021-09-22 추석 연휴
2021-10-03 개천절
2021-10-04 개천절 대체공휴일
2021-10-09 한글날
2021-10-11 한글날 대체공휴일
2021-12-25 성탄절
2022-01-01 신정
2022-01-31 설날 연휴
2022-02-01 설날 연휴
2022-02-02 설날 연휴
2022-03-01 삼일절
2022-03-09 제20대 대통령선거
2022-05-05 어린이날
2022-05-08 부처님오신날
2022-06-01 제8회 전국동시지방선거
2022-06-06 현충일
2022-08-15 광복절
2022-09-09 추석 연휴
2022-09-10 추석 연휴
2022-09-11 추석 연휴
2022-09-12 추석 대체공휴일
2022-10-03 개천절
2022-10-09 한글날
2022-10-10 한글날 대체공휴일
2022-12-25 성탄절
2023-01-01 신정
2023-01-21 설날 연휴
2023-01-22 설날 연휴
2023-01-23 설날 연휴
2023-01-24 설날 대체공휴일
2023-03-01 삼일절
2023-05-05 어린이날
2023-05-27 부처님오신날
2023-05-29 부처님오신날 대체공휴일
2023-06-06 현충일
2023-08-15 광복절
2023-09-28 추석 연휴
2023-09-29 추석 연휴
2023-09-30 추석 연휴
2023-10-02 임시공휴일
2023-10-03 개천절
2023-10-09 한글날
2023-12-25 성탄절
2024-01-01 신정
2024-02-09 설날 연휴
2024-02-10 설날 연휴
2024-02-11 설날 연휴
2024-02-12 설날 대체공휴일
2024-03-01 삼일절
2024-04-10 제22대 국회의원선거
2024-05-05 어린이날
2024-05-06 어린이날 대체공휴일
2024-05-15 부처님오신날
2024-06-06 현충일
2024-08-15 광복절
2024-09-16 추석 연휴
2024-09-17 추석 연휴
2024-09-18 추석 연휴
2024-10-01 국군의 날 임시공휴일
2024-10-03 개천절
2024-10-09 한글날
2024-12-25 성탄절
2025-01-01 신정
2025-01-27 임시공휴일
2025-01-28 설날 연휴
2025-01-29 설날 연휴
2025-01-30 설날 연휴
2025-03-01 삼일절
2025-03-03 삼일절 대체공휴일
2025-05-05 어린이날·부처님오신날
2025-05-06 부처님오신날 대체공휴일
2025-06-03 제21대 대통령선거 임시공휴일
2025-06-06 현충일
2025-08-15 광복절
2025-10-03 개천절
2025-10-05 추석 연휴
2025-10-06 추석 연휴
2025-10-07 추석 연휴
2025-10-08 추석 대체공휴일
2025-10-09 한글날
2025-12-25 성탄절
2026-01-01 신정
2026-02-16 설날 연휴
2026-02-17 설날 연휴
2026-02-18 설날 연휴
2026-03-01 삼일절
2026-03-02 삼일절 대체공휴일
2026-05-01 노동절
2026-05-05 어린이날
2026-05-24 부처님오신날
2026-05-25 부처님오신날 대체공휴일
2026-06-03 제9회 전국동시지방선거
2026-06-06 현충일
2026-07-17 제헌절
2026-08-15 광복절
2026-08-17 광복절 대체공휴일
2026-09-24 추석 연휴
2026-09-25 추석 연휴
2026-09-26 추석 연휴
2026-10-03 개천절
2026-10-05 개천절 대체공휴일
2026-10-09 한글날
2026-12-25 성탄절
"""

# --- fixed values: sentence formats of the rule-based briefing ----------------------------
BRIEF_CURRENT = ("%s에 확정된 전력은 **%s kW**예요. "
                 "오늘 지금까지 가장 높았던 전력은 %s kW였어요.")
BRIEF_FORECAST = "다음 구간인 %s에는 **%s kW**로 예상돼요. "
BRIEF_ABOVE = "알림 기준 %s kW보다 %s kW 높아요."
BRIEF_REACHED = "알림 기준 %s kW에 도달할 것으로 보여요."
BRIEF_BELOW = "알림 기준 %s kW까지 %s kW의 여유가 있어요."
BRIEF_ADVICE_RISK = ("미룰 수 있는 부하가 있다면 시작을 다음 구간으로 조정하고, "
                     "설비 시동이 한꺼번에 겹치지 않도록 확인해 주세요.")
BRIEF_ADVICE_CALM = "지금은 운전을 유지하면서 다음 구간의 실제 전력이 예상과 비슷한지 확인해 주세요."
BRIEF_ERROR = "오늘 확정된 구간의 평균 예측 오차는 %s kW예요. "
BRIEF_NO_ERROR = "아직 오늘의 예측 오차를 계산할 확정 자료가 없어요. "
BRIEF_CLOSING = "예측은 달라질 수 있으니 실제 측정값도 함께 살펴봐 주세요."


def holidays() -> list[tuple[str, str]]:
    """The calendar as (date, name) pairs in date order."""
    return [tuple(line.split(" ", 1)) for line in HOLIDAYS_TEXT.strip().splitlines()]


def calendar_years() -> list[int]:
    return sorted({int(day[:4]) for day, _ in holidays()})

# fixed values: texts of a CSV field that mean a missing value
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# fixed values: field names of a stored results document
RESULTS_FOLDS = "구간별_원자료"            # model -> fold -> scores
RESULTS_SEARCH = "결합비율탐색"            # the search for the blend weight
RESULTS_TABLE = "표"                    # its table: one entry per weight
RESULTS_WEIGHT, RESULTS_FORWARD, RESULTS_TEST = "트리비중", "전진검증_평균", "시험"
RESULTS_CHOSEN, RESULTS_BY = "선정_트리비중", "선정기준"
RESULTS_SCORES = ("MSE", "RMSE", "MAE", "R2", "bias", "rows")
