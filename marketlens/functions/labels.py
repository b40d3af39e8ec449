"""Report labels and thresholds that must equal the source
system's output text.  Kept together, in natural order."""

# Scope label of the delivery KPI row (Q1).
SCOPE_ALL = "整体"

# ABC classes of the SQL Pareto report (Q8) and the mart (M5).
ABC_SQL_LABELS = ("A类(核心)", "B类(重要)", "C类(长尾)")
ABC_MART_LABELS = ("A", "B", "C")
ABC_PCT_BOUNDS = (70, 90)
ABC_FRACTION_BOUNDS = (0.70, 0.90)

# Seller category-coverage segments.
SELLER_TYPES = ("单品类", "2-3品类", "4-5品类", "5+品类")

# Delivery-type labels.
DELAYED_LABEL = "延迟交付"
ON_TIME_LABEL = "按时交付"

# Delivery-day ranges of Q12 (B1): upper bounds and labels.
Q12_BOUNDS = (5, 10, 15, 20, 30)
Q12_LABELS = ("0-5天", "6-10天", "11-15天", "16-20天", "21-30天")
Q12_ELSE = "30天以上"

# Review cohorts of Q15.
NEGATIVE_COHORT = "差评订单(≤2分)"
POSITIVE_COHORT = "好评订单(5分)"

# Weekday names by SQL DAYOFWEEK 1 (Sunday) .. 7 (Saturday).
DOW_SUN1_NAMES = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")

# Weekday names by pandas dayofweek 0 (Monday) .. 6 (Sunday).
DOW_MON0_NAMES = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")

# Month names 1 .. 12.
MONTH_NAMES = ("1月", "2月", "3月", "4月", "5月", "6月", "7月", "8月", "9月", "10月", "11月", "12月")

# RFM segments by total score (Q21, R31, B7): lower bounds and labels.
RFM_BOUNDS = (10, 7, 5)
RFM_LABELS = ("高价值客户", "潜力客户", "一般客户", "流失风险客户")

# Review buckets of the warehouse report.
Q34_BOUNDS = (10, 20, 30, 40)
Q34_LABELS = ("0-10天", "11-20天", "21-30天", "31-40天")
Q34_ELSE = "40天以上"

# Pandas day bins of the satisfaction factors chart.
R22_EDGES = (0, 5, 10, 15, 20, 30, 50, 200)
R22_LABELS = ("0-5天", "6-10天", "11-15天", "16-20天", "21-30天", "31-50天", "50天+")

# Day bins of the insight table.
R24_EDGES = (0, 7, 15, 30, 200)

# Verdict of the score ~ days regression (ST4).
VERDICT_NEGATIVE = "显著负相关"
VERDICT_WEAK = "弱相关"
VERDICT_R_BOUND = -0.1

# Fixed RFM reference date of the warehouse queries (Q42).
WAREHOUSE_RFM_DATE = "2018-10-01"

# Brazilian states → names and regions, for source data in the
# original shape (P10).  Unmapped states get region 'Unknown'.
STATE_NAMES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas",
    "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo",
    "GO": "Goiás", "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul",
    "MG": "Minas Gerais", "PA": "Pará", "PB": "Paraíba", "PR": "Paraná",
    "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte",
    "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina",
    "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}
REGIONS = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MT", "MS"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}
UNKNOWN_REGION = "Unknown"
