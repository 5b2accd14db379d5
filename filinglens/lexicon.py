"""Fixed vocabularies and constants of the filing domain.

Everything here is data: Korean disclosure terms, report codes, account names
and thresholds that results depend on.  Operators take them as parameters, so a
caller can pass other lists.
"""

# --- fixed values: report classes -------------------------------------------
REPORT_TYPES = {"사업보고서": "annual", "반기보고서": "semiannual", "분기보고서": "quarterly"}
FORM_CODES = {"annual": "A001", "semiannual": "A002", "quarterly": "A003", "securities": "C001"}
STATEMENT_REPORT_CODES = {"annual": "11011", "semiannual": "11012", "quarterly_1": "11013", "quarterly_3": "11014"}
SECURITIES_REPORT = "증권신고서(지분증권)"
VIEWER_URL = "https://dart.fss.or.kr/dsaf001/main.do?rcpNo="

# --- fixed values: periods ---------------------------------------------------
PERIOD_TYPES = {"annual": "FY", "semiannual": "H1_YTD", "quarterly_1": "Q1_YTD", "quarterly_3": "Q3_YTD"}
PERIOD_PRIORITY = {"FY": 0, "Q1_YTD": 1, "H1_YTD": 2, "Q3_YTD": 3}

# --- fixed values: seven standard accounts (statements, ids, names) ----------
ACCOUNTS = [
    ("revenue", ["IS", "CIS"], ["ifrs-full_Revenue", "dart_Revenue"],
     ["매출액", "매출", "영업수익", "수익(매출액)", "수익"]),
    ("operating_income", ["IS", "CIS"], ["dart_OperatingIncomeLoss"],
     ["영업이익", "영업이익(손실)", "영업손익"]),
    ("net_income", ["IS", "CIS"], ["ifrs-full_ProfitLoss", "ifrs-full_ProfitLossAttributableToOwnersOfParent"],
     ["당기순이익", "당기순이익(손실)", "분기순이익", "반기순이익", "연결당기순이익"]),
    ("operating_cash_flow", ["CF"], ["ifrs-full_CashFlowsFromUsedInOperatingActivities"],
     ["영업활동현금흐름", "영업활동으로인한현금흐름", "영업활동으로 인한 현금흐름"]),
    ("total_assets", ["BS"], ["ifrs-full_Assets"], ["자산총계", "자산총액"]),
    ("total_liabilities", ["BS"], ["ifrs-full_Liabilities"], ["부채총계", "부채총액"]),
    ("total_equity", ["BS"], ["ifrs-full_Equity"], ["자본총계", "자본총액"]),
]

# --- fixed values: section headings ------------------------------------------
SLICE_STARTS = ["Ⅱ. 사업의 내용", "II. 사업의 내용", "사업의 내용", "사업의 개요", "주요 제품 및 서비스",
                "주요 제품 및 용역", "주요 제품", "매출 및 수주상황"]
SLICE_ENDS = ["Ⅲ. 재무에 관한 사항", "III. 재무에 관한 사항", "재무에 관한 사항", "감사인의 감사의견",
              "이사회 등 회사의 기관", "주주에 관한 사항", "임원 및 직원 등에 관한 사항"]
REGION_STARTS = ["Ⅱ. 사업의 내용", "II. 사업의 내용", "사업의 내용", "1. 사업의 개요", "사업의 개요",
                 "주요 제품 및 서비스", "주요 제품 및 용역", "주요 제품", "매출 및 수주상황"]
REGION_ENDS = ["Ⅲ. 재무에 관한 사항", "III. 재무에 관한 사항", "재무에 관한 사항", "Ⅳ. 감사인의 감사의견",
               "IV. 감사인의 감사의견", "감사인의 감사의견", "이사회 등 회사의 기관", "주주에 관한 사항",
               "임원 및 직원 등에 관한 사항"]
SLICE_FALLBACK_CHARS = 150000
REGION_FALLBACK_CHARS = 60000
REGION_MIN_CHARS = 500

# --- fixed values: sentence filters --------------------------------------------
OFFERING_NOISE = ["수요예측", "일반청약자", "기관투자자", "청약기일", "청약일", "공모주식", "상장공모", "희망공모가",
                  "확정공모가", "공모가격", "공모가액", "공모방법", "공모금액", "인수회사", "대표주관회사",
                  "공동주관회사", "인수단", "환매청구권", "상장예비심사", "유가증권시장 상장"]
LEGAL_NOISE = ["자본시장과 금융투자업에 관한 법률", "증권 인수업무", "집합투자기구", "투자신탁", "고위험고수익",
               "조세특례제한법", "금융투자업자"]
RISK_NOISE = ["투자자께서는", "투자위험", "투자의사", "투자 의사", "유의하시기 바랍니다"]
DISPUTE_NOISE = ["소송", "분쟁", "손해배상", "상표권 침해", "형사고소", "고소", "원고", "피고", "법원", "재심", "확정판결"]
NOISE_TERMS = OFFERING_NOISE + LEGAL_NOISE + RISK_NOISE + DISPUTE_NOISE
CORRECTION_NOTES = ["정정 전", "정정사항"]
CORRECTION_NOTE_CHARS = 400
PEER_TERMS = ["비교기업", "유사회사", "유사기업", "비교회사", "비교대상", "비교 대상", "사업유사성", "사업 유사성",
              "재무유사성", "재무 유사성", "업종 관련성", "선정하였습니다", "선정 기준", "선정기준", "제외하였습니다",
              "유사성이 적", "차이점이 있습니다", "사업구조의 차이"]
OTHER_COMPANY_WORD = "동사"
INDUSTRY_TERMS = ["시장규모", "시장 규모", "시장 성장", "시장성장", "경쟁 심화", "진입 장벽", "산업 특성", "산업의 특성",
                  "시장 전망", "산업 성장", "산업성장", "경쟁업체", "경쟁 환경"]
SELF_ANCHORS = ["당사", "자사"]
NAME_PREFIXES = ["㈜", "(주)"]
SELF_WEIGHTS = [("당사", 4), ("자사", 3), ("회사는", 1)]
NAME_WEIGHT = 4
CATEGORY_PAIR_BONUS = [("business", "product", 2), ("product", "brand", 2), ("product", "market", 2), ("brand", "market", 1)]
SENTENCE_MIN_CHARS = 30
SENTENCE_MAX_CHARS = 1200
NEAR_DUPLICATE_RATIO = 0.93
PROFILE_CATEGORIES = ["business", "product", "brand", "market"]
CORE_PER_CATEGORY = 5
CORE_MAX_ITEMS = 40

# --- fixed values: profile keyword dictionary -----------------------------------
PROFILE_KEYWORDS_COMMON = {
    "business": ["사업부문", "사업 부문", "사업영역", "사업 영역", "주요 사업", "주요사업", "사업구조", "사업 구조",
                 "사업모델", "사업 모델", "비즈니스", "D2C"],
    "product": ["주요 제품", "주요제품", "제품군", "제품", "상품", "서비스"],
    "brand": ["브랜드", "상표"],
    "market": ["국내 시장", "국내시장", "해외 시장", "해외시장", "글로벌 시장", "글로벌시장", "시장 규모", "시장규모",
               "시장 성장", "시장성장", "시장 점유율", "시장점유율", "해외 매출", "해외매출", "해외 판매", "해외판매",
               "수출", "글로벌", "해외 진출", "해외진출"],
}
PROFILE_KEYWORDS_BEAUTY = {
    "business": [],
    "product": ["화장품", "디바이스", "미용기기", "뷰티 디바이스", "홈 뷰티"],
    "brand": ["메디큐브", "AGE-R", "에이지알"],
    "market": ["K-뷰티"],
}

# --- fixed values: candidate-pool concept groups --------------------------------
INDUSTRY_GROUPS = {
    "cosmetics": ["화장품", "코스메틱", "스킨케어"],
    "beauty_device": ["미용기기", "미용 기기", "뷰티 디바이스", "홈 뷰티", "피부미용", "피부 미용"],
    "beauty_general": ["뷰티"],
}
BUSINESS_GROUPS = {
    "brand": ["브랜드"],
    "d2c": ["D2C", "d2c", "자사몰", "온라인몰", "온라인 판매"],
    "global": ["글로벌", "수출", "해외 판매", "해외판매", "해외법인", "해외 법인"],
    "production": ["자체 생산", "자체생산"],
    "rnd": ["연구개발", "연구 개발"],
}
INDUSTRY_GROUP_WEIGHT = 3
BUSINESS_GROUP_WEIGHT = 1
MIN_INDUSTRY_GROUPS = 1
MIN_BUSINESS_GROUPS = 2
MAX_CANDIDATES = 50
LOOKBACK_DAYS = 800
SIZE_BAND = (0.3, 3.0)

# --- fixed values: evidence categories -------------------------------------------
EVIDENCE_CATEGORIES = ["business", "growth", "risk", "finance"]
REPORT_PRIORITY = {
    "business": ["annual", "semiannual", "quarterly"],
    "growth": ["quarterly", "semiannual", "annual"],
    "risk": ["annual", "semiannual", "quarterly"],
    "finance": ["quarterly", "semiannual", "annual"],
}
PRIORITY_WEIGHTS = [1.30, 1.15, 1.00]
CATEGORY_KEYWORDS = {
    "business": ["사업", "사업부문", "제품", "주요제품", "서비스", "브랜드", "매출", "판매", "판매경로", "유통", "유통경로",
                 "채널", "고객", "매출처", "거래처", "시장", "생산", "원재료", "매입처", "완제품", "외주", "위탁생산",
                 "자사몰", "온라인", "오프라인", "백화점", "면세점", "홈쇼핑", "오픈마켓", "수출", "내수", "경쟁", "경쟁사",
                 "경쟁력", "시장여건"],
    "growth": ["성장", "매출", "신규", "신사업", "신규사업", "신제품", "신규제품", "출시", "해외", "해외시장", "수출", "진출",
               "글로벌", "확장", "투자", "설비", "설비투자", "공장", "생산능력", "생산시설", "유통망", "매장", "법인",
               "해외법인", "판매채널", "입점", "브랜딩", "기획역량", "경쟁", "경쟁력", "시장"],
    "risk": ["위험", "리스크", "집중", "집중도", "의존", "의존도", "공급", "공급업체", "매입처", "원재료", "원료", "매입",
             "조달", "가격변동", "외주", "위탁", "위탁생산", "외주생산", "완제품", "고객", "고객사", "주요고객", "매출처",
             "주요매출처", "거래처", "제품", "브랜드", "사업부문", "매출비중", "지역", "국가", "국내", "해외", "수출", "규제",
             "법률", "법령", "허가", "인증", "승인", "인허가", "의료기기", "화장품", "경쟁", "경쟁사", "경쟁업체", "시장경쟁",
             "가격경쟁", "시장여건", "진입장벽", "시장점유율", "경쟁력", "차별화", "핵심역량", "브랜딩", "기획역량"],
    "finance": ["매출", "매출액", "영업이익", "영업손익", "당기순이익", "분기순이익", "반기순이익", "자산", "자산총계", "부채",
                "부채총계", "자본", "자본총계", "현금흐름", "영업활동현금흐름", "재무", "재무상태표", "손익계산서"],
}

# --- fixed values: chunking -------------------------------------------------------
CHUNK_MAX_CHARS = 900
CHUNK_MIN_CHARS = 80
CHUNK_OVERLAP_CHARS = 100
BLOCK_MAX_CHARS = 1800
HEADING_PATTERNS = [r"^\d+\.\s*.+", r"^[가-힣]\.\s*.+", r"^\(\d+\)\s*.+", r"^[IVX]+\.\s*.+", r"^【.+】$"]
HEADING_KEYWORDS = ["주요 사업", "매출 및 수주", "판매경로", "판매방법", "위험관리", "연구개발", "생산 및 설비", "주요 제품",
                    "원재료", "신규사업", "시장위험"]
HEADING_KEYWORD_CHARS = 80

# --- fixed values: profile fields (category, field, code, label, retrieval categories) --
PROFILE_FIELDS = [
    ("business", "products_services", "B1", "주요 제품·서비스", ["business"]),
    ("business", "revenue_model", "B2", "수익모델", ["business"]),
    ("business", "customer_type", "B3", "고객 유형", ["business"]),
    ("business", "distribution_channel", "B4", "판매·유통 채널", ["business"]),
    ("business", "business_structure", "B5", "사업 구조", ["business"]),
    ("growth", "new_business", "G5-1", "신규사업", ["growth", "business"]),
    ("growth", "new_products", "G5-2", "신규제품", ["growth", "business"]),
    ("growth", "new_markets", "G5-3", "신규시장", ["growth", "business"]),
    ("growth", "new_channels", "G5-4", "신규채널", ["growth", "business"]),
    ("growth", "capacity_expansion", "G5-5", "설비확장", ["growth", "business"]),
    ("risk", "supplier_raw_material_concentration", "R1", "공급업체·원재료 집중도", ["business", "risk"]),
    ("risk", "customer_concentration", "R2", "고객 집중도", ["business", "risk"]),
    ("risk", "product_concentration", "R3", "제품 집중도", ["business", "risk"]),
    ("risk", "geographic_concentration", "R4", "지역 집중도", ["business", "growth", "risk"]),
    ("risk", "regulatory_risk", "R5", "규제", ["business", "risk"]),
    ("risk", "competition_intensity", "R6-1", "경쟁 강도", ["business", "growth", "risk"]),
    ("risk", "competitors", "R6-2", "경쟁사", ["business", "growth", "risk"]),
    ("risk", "differentiation", "R6-3", "차별화", ["business", "growth", "risk"]),
]
FIELD_STATUSES = ["확인", "부분확인", "미공시", "해당없음"]
QUERY_BONUS = 0.03
CATEGORY_BONUS = 0.01
TOP_K_PER_QUERY = 3
EVIDENCE_LIMIT = 8

# --- fixed values: keyword graph ------------------------------------------------------
KEYWORDS_PER_SENTENCE = 4
MMR_DIVERSITY = 0.5
MAX_GRAPH_NODES = 60
MIN_KEYWORD_SCORE = 0.35
NODE_MATCH_THRESHOLD = 0.75
EDGE_MATCH_THRESHOLD = 0.70
UNMATCHED_PREFIX = "__candidate__::"
KEYWORD_STOPWORDS = ["당사", "자사", "회사", "기업", "있습니다", "있으며", "입니다", "합니다", "하였습니다", "되었습니다",
                     "통해", "위해", "대한", "경우", "관련", "등", "및", "수", "것"]
KEYWORD_NOISE_PHRASES = ["부정적인 영향", "긍정적인 영향", "영향 미칠", "영향을 미칠", "계획입니다", "예정입니다", "있습니다",
                         "하고 있습니다", "할 수 있습니다", "증가할 수", "감소할 수"]
CENTRALITY_NOISE_PHRASES = ["주요 연혁", "연혁", "주1", "주 1", "사업내용은 다음", "사업영역을 요약", "사업내용을 요약",
                            "독점규제", "공정거래", "독점규제및공정거래에관한법률", "화장품법", "관련 법률", "법률",
                            "대표이사", "주요 임원", "임원들은", "임원은", "피합병법인", "합병법인", "지분 보유",
                            "선정", "향후 필요한", "reason 가치"]

# --- fixed values: filing versions and valuation ------------------------------------------
VERSION_FIELDS = {
    "peer_selection": ["비교기업 선정", "사업 유사성", "재무 유사성", "업종 관련성", "유사회사 선정"],
    "per_method": ["주가수익비율(PER)", "PER 상대가치", "유사회사의 PER"],
    "final_offer_price": ["확정공모가액", "확정 공모가액"],
}
PEER_SELECTION_TERMS = ["사업 유사성", "재무 유사성", "업종 관련성", "일반사항", "선정"]
PEER_CRITERIA = ["업종 관련성", "사업 유사성", "재무 유사성", "일반사항"]
PER_TERMS = ["PER", "주가수익비율"]
VALUATION_TERMS = ["비교가치", "상대가치", "공모가", "유사회사", "평가"]
FINAL_PRICE_PATTERN = r"(?s)(?:확정공모가액|확정\s*공모가액).{0,100}?([0-9]{1,3}(?:,[0-9]{3})+)\s*원"
FUTURE_TERMS = ["예정입니다", "예정이며", "결정할 예정", "최종 결정할 예정"]
CONFIRMED_TERMS = ["확정되었습니다", "최종 결정하였습니다"]
SUPERSEDED_MARK = "정정 전"
CURRENT_MARK = "정정 후"
SUPERSEDED_WINDOW = 200
VALUATION_PATTERNS = {
    "valuation_price": [r"(?s)주당\s*평가가액.{0,100}?([0-9]{1,3}(?:,[0-9]{3})+)\s*원",
                        r"(?s)평가가액.{0,100}?([0-9]{1,3}(?:,[0-9]{3})+)\s*원"],
    "discount_rate": [r"(?s)평가액\s*대비\s*할인율.{0,100}?([0-9]+(?:\.[0-9]+)?)\s*%\s*[~∼\-]\s*([0-9]+(?:\.[0-9]+)?)\s*%"],
    "offer_price_band": [r"(?s)(?:희망공모가액\s*밴드|희망공모가액).{0,100}?([0-9]{1,3}(?:,[0-9]{3})+)\s*원?\s*[~∼\-]\s*([0-9]{1,3}(?:,[0-9]{3})+)\s*원"],
}
PRESENCE_KEYWORDS = ["사업의 내용", "사업의 개요", "주요 제품", "제품 및 서비스", "브랜드", "사업", "제품", "비교기업", "유사회사",
                     "사업 유사성", "재무 유사성", "업종 관련성", "PER", "주가수익비율", "상대가치", "주당 평가가액", "평가가액",
                     "할인율", "희망공모가액", "확정공모가액"]

# --- fixed values: recall audit -------------------------------------------------------------
AUDIT_FIELDS = {
    "R2_customer_concentration": ["주요 고객", "주요고객", "고객사", "주요 매출처", "주요매출처", "매출처", "거래처", "10%", "10％", "의존도"],
    "R5_regulatory_risk": ["규제", "법률", "법령", "인허가", "허가", "승인", "인증", "의료기기법", "화장품법", "표시광고",
                           "식품의약품안전처", "식약처"],
    "R6_2_competitors": ["경쟁사", "경쟁업체", "경쟁기업", "동종업계", "시장점유율", "점유율", "경쟁 현황", "경쟁현황"],
}

# --- fixed values: markup families --------------------------------------------------------------
DOCUMENT_SUFFIXES = (".xml", ".html", ".htm", ".xhtml")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")
TABLE_TAGS = ("table", "table-group")
ROW_TAGS = ("tr", "row")
CELL_TAGS = ("td", "th", "te", "tu", "entry")
IMAGE_TAGS = ("img", "image", "graphic")
SILENT_TAGS = ("script", "style", "noscript")
TEXT_ENCODINGS = ("utf-8", "cp949", "euc-kr")
