"""Rule tables.

Every operator takes its rule table as an argument; the medical tables below
are only the defaults.
"""

# --------------------------------------------------------------------------
# Fixed values. These must stay exactly as they are for results to agree.
# --------------------------------------------------------------------------

EVIDENCE_LEVELS = ["rct", "meta", "guideline", "observational", "ebook", "wiki", "other"]
SOURCE_NAMES = ["pubmed", "clinicaltrials", "europepmc", "local", "wiki"]

# Level from publication type and title; first matching row wins.
TITLE_LEVEL_RULES = [
    ("guideline", ["guideline", "practice guideline", "指南", "consensus"]),
    ("meta", ["meta-analysis", "meta analysis", "systematic review", "荟萃"]),
    ("rct", ["randomized", "randomised", "clinical trial", "controlled trial", "随机"]),
    ("observational", ["cohort", "observational", "case-control", "cross-sectional",
                       "case series", "case report"]),
    ("ebook", ["book", "ebook", "chapter", "手册"]),
    ("wiki", ["wiki", "维基"]),
]

# Second chance for level "other", from title + text.
TEXT_LEVEL_RULES = [
    ("meta", ["meta-analysis", "meta analysis", "systematic review", "umbrella review",
              "荟萃", "系统综述", "伞形综述"]),
    ("guideline", ["guideline", "指南", "recommendation", "consensus"]),
    ("rct", ["randomized", "randomised", "randomized controlled", "随机对照", "double-blind", "双盲"]),
    ("observational", ["cohort", "observational", "case-control", "队列", "横断面", "观察性"]),
]

# Fallback levels of the literature-table reader, after TITLE_LEVEL_RULES.
LITERATURE_LEVEL_RULES = [
    ("meta", ["meta", "综述", "systematic review"]),
    ("rct", ["rct", "随机对照"]),
    ("observational", ["cohort", "队列"]),
    ("guideline", ["guideline", "指南"]),
]

SOURCE_TYPE_LEVELS = {
    "guideline": "guideline",
    "umbrella_review": "meta",
    "systematic_review": "meta",
    "meta_analysis": "meta",
    "randomized_controlled_trial": "rct",
    "cohort_study": "observational",
}

# Base weights (priority order of the corpus side) and retrieval multipliers.
LEVEL_PRIORITY = {
    "meta": 1.0, "guideline": 0.95, "rct": 0.9, "wiki": 0.8,
    "observational": 0.6, "ebook": 0.4, "other": 0.3,
}
LEVEL_BOOST = {
    "guideline": 1.25, "meta": 1.2, "rct": 1.15, "observational": 1.05,
    "wiki": 1.1, "ebook": 1.0, "other": 1.0,
}

# Topic tags by substring, one table per source.
PUBMED_TAGS = [
    ("hypertension", ["hypertension", "blood pressure", "高血压", "血压"]),
    ("hyperlipidemia", ["lipid", "cholesterol", "血脂", "胆固醇", "ldl", "hdl"]),
    ("diabetes", ["diabetes", "glycemic", "糖尿病", "血糖"]),
    ("cardiovascular", ["cardiovascular", "coronary", "心血管", "冠心病"]),
    ("diet", ["diet", "dietary", "nutrition", "饮食", "营养", "sodium", "钠"]),
    ("mediterranean", ["mediterranean", "地中海"]),
    ("dash", ["dash"]),
    ("fiber", ["fiber", "fibre", "whole grain", "whole-grain", "膳食纤维", "全谷物"]),
    ("plant_based", ["plant-based", "plant based", "vegetarian", "植物性", "素食"]),
    ("sugar", ["sugar-sweetened", "sugary drink", "added sugar", "含糖"]),
    ("ultra_processed", ["ultra-processed", "ultraprocessed", "超加工"]),
    ("obesity", ["obesity", "overweight", "weight loss", "体重", "肥胖"]),
    ("low_carb", ["low-carbohydrate", "low carbohydrate", "低碳"]),
    ("omega3", ["omega-3", "omega 3"]),
    ("guideline", ["guideline", "指南", "recommendation"]),
]
EUROPEPMC_TAGS = [
    ("hypertension", ["hypertension", "blood pressure", "高血压"]),
    ("hyperlipidemia", ["lipid", "cholesterol", "血脂"]),
    ("diabetes", ["diabetes", "糖尿病"]),
    ("cardiovascular", ["cardiovascular", "心血管"]),
    ("diet", ["diet", "nutrition", "sodium", "饮食"]),
    ("mediterranean", ["mediterranean", "地中海"]),
    ("dash", ["dash"]),
    ("fiber", ["fiber", "fibre", "whole grain", "whole-grain", "膳食纤维", "全谷物"]),
    ("plant_based", ["plant-based", "plant based", "vegetarian", "植物性", "素食"]),
    ("sugar", ["sugar-sweetened", "sugary drink", "added sugar", "含糖"]),
    ("ultra_processed", ["ultra-processed", "ultraprocessed", "超加工"]),
    ("obesity", ["obesity", "overweight", "weight loss", "体重", "肥胖"]),
    ("low_carb", ["low-carbohydrate", "low carbohydrate", "低碳"]),
    ("omega3", ["omega-3", "omega 3"]),
]
TRIAL_TAGS = [
    ("hypertension", ["hypertension", "blood pressure"]),
    ("hyperlipidemia", ["hyperlipid", "cholesterol", "dyslipid"]),
    ("diabetes", ["diabetes"]),
    ("cardiovascular", ["cardiovascular", "coronary"]),
    ("diet", ["diet", "nutrition", "sodium"]),
    ("fiber", ["fiber", "whole grain"]),
    ("plant_based", ["plant-based", "plant based", "vegetarian"]),
    ("sugar", ["sugar-sweetened", "sugary drink", "added sugar"]),
    ("ultra_processed", ["ultra-processed", "ultraprocessed"]),
    ("obesity", ["obesity", "overweight", "weight loss"]),
    ("low_carb", ["low-carbohydrate", "low carbohydrate"]),
    ("omega3", ["omega-3", "omega 3"]),
]
LOCAL_TAGS = [
    ("hypertension", ["hypertension", "blood pressure", "高血压", "血压"]),
    ("hyperlipidemia", ["lipid", "cholesterol", "血脂", "胆固醇"]),
    ("diabetes", ["diabetes", "glycemic", "糖尿病", "血糖"]),
    ("cardiovascular", ["cardiovascular", "coronary", "心血管", "冠心病"]),
    ("diet", ["diet", "dietary", "nutrition", "饮食", "营养", "sodium", "钠"]),
    ("mediterranean", ["mediterranean", "地中海"]),
    ("guideline", ["guideline", "指南", "recommendation"]),
]

# Question gates.
DOMAIN_HINTS = [
    "高血压", "血压", "血脂", "胆固醇", "糖尿病", "血糖", "心血管", "地中海",
    "限钠", "钠", "盐", "饮食", "营养", "他汀", "dash", "hypertension",
    "lipid", "cholesterol", "diabetes", "diet", "mediterranean", "sodium",
    "statin", "blood pressure", "cardiovascular", "膳食纤维", "全谷物", "全谷",
    "含糖饮料", "甜饮料", "超加工", "植物性", "植物基", "低碳", "低碳水",
    "间歇性禁食", "轻断食", "肥胖", "减重", "体重", "坚果", "豆类", "鱼油",
    "omega", "whole grain", "dietary fiber", "sugar-sweetened", "ultra-processed",
    "plant-based", "low-carbohydrate", "intermittent fasting", "obesity",
]
OUT_OF_SCOPE = [
    "火星", "紫水晶", "水晶手链", "手链", "风水", "气功包治", "替代抗生素治肺炎",
    "外星人", "永动机", "mars dust", "crystal bracelet",
]
MIN_OVERLAP = 0.12
PREFER_LEVELS = ["guideline", "meta", "rct", "wiki", "observational"]
EXPECT_LEVELS = ["guideline", "meta", "rct"]
BOOST_TAGS = [
    "diet", "mediterranean", "dash", "hypertension", "hyperlipidemia", "diabetes",
    "fiber", "plant_based", "sugar", "ultra_processed", "obesity", "low_carb", "omega3",
]

# Consumer wording -> search phrase.
QUERY_ALIASES = [
    (["膳食纤维", "纤维", "全谷", "全麦", "粗粮"], "dietary fiber whole grains cardiovascular risk"),
    (["含糖饮料", "甜饮料", "奶茶", "可乐", "饮料含糖"], "sugar-sweetened beverages diabetes cardiovascular risk"),
    (["超加工", "加工食品", "加工零食"], "ultra-processed foods cardiovascular diabetes"),
    (["植物性", "植物基", "素食"], "plant-based diet vegetarian diet cardiovascular"),
    (["低碳", "低碳水", "生酮"], "low-carbohydrate diet type 2 diabetes glycemic control"),
    (["间歇性禁食", "轻断食", "断食"], "intermittent fasting diabetes weight loss"),
    (["坚果"], "nuts cardiovascular risk"),
    (["豆类", "豆制品", "豆子"], "legumes cardiovascular diabetes"),
    (["鱼油", "欧米伽", "omega", "omega-3"], "omega-3 fatty acids cardiovascular"),
    (["地中海"], "Mediterranean diet cardiovascular risk"),
    (["dash", "得舒"], "DASH diet blood pressure hypertension"),
    (["限钠", "低钠", "少盐", "盐"], "dietary sodium blood pressure hypertension"),
    (["肥胖", "减重", "减肥", "体重"], "obesity weight loss dietary intervention cardiovascular risk"),
]

# Questions that ask for a dose.
DOSAGE_PATTERNS = [
    r"药量|剂量|服药方案|怎么吃(这|那个)?药|用药量",
    r"吃(多少|几)药",
    r"(几片|几粒|多少片|多少粒|每天\d+片|一次\d+粒)",
    r"\d+\s*(mg|毫克|片|粒|单位)\s*(怎么|多少|几次|服用|吃)",
    r"(胰岛素|降糖药|降压药|他汀).{0,12}(多少|几|剂量|用量|单位)",
    r"一天(吃|服|用)(几|多少|几次|\d+次|\d+片|\d+粒)",
    r"(停|减|换|加)药|药量(减半|调整|减少)|停药|减量|增量|加量",
    r"能(不能)?(停|减|换)药",
    r"药.{0,2}(吃|服)(多久|几天|多长时间|能不能停)",
]
DOSE_AMOUNT_PATTERN = r"\d+(\.\d+)?\s*(mg|毫克|克|g|片|粒|单位)"
DOSE_WORDS = ["服药", "吃药", "用药", "剂量", "每次", "每天服用", "每日服用"]
DOSE_WARNING = "\n\n> ⚠️ 如涉及具体药量/剂量，请以医生或药师的意见为准，切勿自行调整。"

# Plain-language replacements, applied one after the other in this order.
PLAIN_TERMS = [
    ("低密度脂蛋白胆固醇（LDL-C）", "低密度脂蛋白胆固醇（俗称「坏胆固醇」）"),
    ("高密度脂蛋白胆固醇（HDL-C）", "高密度脂蛋白胆固醇（俗称「好胆固醇」）"),
    ("低密度脂蛋白胆固醇", "低密度脂蛋白胆固醇（「坏胆固醇」）"),
    ("高密度脂蛋白胆固醇", "高密度脂蛋白胆固醇（「好胆固醇」）"),
    ("LDL-C", "「坏胆固醇」"),
    ("HDL-C", "「好胆固醇」"),
    ("收缩压", "收缩压（血压读数里的「高压」）"),
    ("舒张压", "舒张压（血压读数里的「低压」）"),
    ("随机对照试验", "随机对照试验（严格对比效果的临床试验，证据强度较高）"),
    ("荟萃分析", "荟萃分析（把多项研究结果合并统计，结论更稳）"),
    ("系统性综述", "系统性综述（系统收集某主题全部研究的综述）"),
    ("systematic review", "系统性综述（系统收集某主题全部研究的综述）"),
    ("meta-analysis", "荟萃分析（把多项研究结果合并统计）"),
    ("甘油三酯", "甘油三酯（血液里的一种脂肪）"),
    ("心脑血管事件", "心脑血管事件（如心梗、中风等严重问题）"),
    ("心血管事件", "心血管事件（如心梗、中风等严重问题）"),
    ("心血管结局", "心血管结局（如心梗、中风等终点事件）"),
    ("心血管风险", "心血管风险（发生心梗、中风等问题的风险）"),
    ("饱和脂肪", "饱和脂肪（肥肉、动物油里较多的脂肪）"),
    ("反式脂肪", "反式脂肪（油炸食品、加工零食里常见的坏脂肪）"),
    ("依从性", "依从性（能否长期坚持）"),
    ("膳食纤维", "膳食纤维（蔬果全谷物里的粗纤维）"),
    ("危险因素", "危险因素（增加患病风险的因素）"),
]

# Advice sentences.
ACTION_WORDS = ["建议", "推荐", "应", "可", "避免", "减少", "增加", "限制", "坚持", "选择", "注意", "有助于", "需要"]
BANNED_TIP_WORDS = ["剂量", "毫克", "mg", "服药", "吃药", "用药", "几片", "几粒", "单位"]

# Citation audit.
INVENTED_PHRASES = [r"根据某项研究", r"著名的 .+ 试验", r"发表于《[^》]+》", r"et al\."]

# Topic pages.
TOPICS = [
    ("hypertension-long-term-meds", "高血压患者为什么需要长期服药", ["hypertension", "guideline"]),
    ("lipid-lifestyle-vs-drugs", "血脂偏高：生活方式干预与药物治疗的证据", ["hyperlipidemia", "diet"]),
    ("mediterranean-diet-cvd", "地中海饮食与心血管风险", ["mediterranean", "diet", "cardiovascular"]),
    ("sodium-hypertension", "限钠饮食对高血压的帮助", ["hypertension", "diet"]),
    ("diabetes-diet", "糖尿病饮食干预与心血管风险", ["diabetes", "diet"]),
    ("dash-diet", "DASH饮食与血压管理", ["hypertension", "diet"]),
    ("statin-evidence", "他汀类药物降低心血管事件的证据要点", ["hyperlipidemia", "cardiovascular"]),
    ("lifestyle-first", "三高管理中的生活方式干预总览", ["diet", "hypertension", "hyperlipidemia", "diabetes"]),
]
TOPIC_SECTIONS = ["一句话结论", "适用范围", "关键证据", "局限与争议", "不该回答什么"]
TOPIC_UPDATED_MARK = "更新于"
TOPIC_DISCLAIMER_MARK = "非诊疗建议"
TOPIC_NO_DOCS = "（暂无相关文档）"
CITED_PREFIXES = ["pmid:", "nct:", "local:", "epmc:", "wiki:"]

# Landed files.
LITERATURE_SKIP_WORDS = ["RAG", "RAGAS", "MMR", "BM25", "RRF", "arXiv", "LLMWiki", "Karpathy"]
LITERATURE_HEADER = "| 证据角色"
LITERATURE_CONTEXT_WORD = "文献"
LITERATURE_TEXT_PREFIX = "文献出处："
CURATED_EXTRA_KEYS = ["source_type", "evidence_role", "authors", "pmcid", "nct", "abstract_en"]
OCR_PAGE_MARK = r"^===== 第\d+页 =====$"

# Cut separators of the chunker, best first; default sizes.
CHUNK_SEPARATORS = ["。", ". ", "；", "; ", "\n"]
CHUNK_MAX_CHARS = 1200
CHUNK_OVERLAP = 150
CHUNK_MIN_CHARS = 120
SECTION_MAX_CHARS = 8000
WHOLE_DOC_MAX_CHARS = 20000

# Refusal message parts.
REFUSAL_NOTHING_FOUND = "未检索到任何证据片段"
REFUSAL_MISSING = {
    "out_of_scope": "该问题不在本系统覆盖领域（高血压/血脂/糖尿病/心血管/饮食营养）内",
    "missing_evidence_type": "检索到的证据等级不足（缺少指南/系统综述/RCT 级别证据）",
    "low_relevance": "证据相关性不足，无法支撑可靠结论",
}
REFUSAL_SUGGEST = {
    "out_of_scope": "可补充该主题的公开指南或研究后重建知识库；必要时请咨询医疗机构",
    "missing_evidence_type": "建议补充检索该主题的指南或随机对照试验（PubMed/ClinicalTrials）后重建知识库",
    "low_relevance": "建议补充检索该主题的指南或随机对照试验（PubMed/ClinicalTrials）后重建知识库",
}
REFUSAL_HEAD = "当前知识库中未找到能直接支持这一结论的高质量证据。\n"
REFUSAL_TAIL = "本系统不提供个体化诊疗建议。"

# Keyword scoring (Okapi BM25) and rank fusion.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
EMBED_DIM = 384
# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------

# Context of a literature table that names none; ours, a parameter of the reader.
LITERATURE_DEFAULT_CONTEXT = "文献表"

# Routing words of `detect_track`; ours, the behaviour is only declared upstream.
NUTRITION_TRACK_WORDS = ["饮食", "吃", "营养", "食物", "diet", "food", "nutrition", "salt", "sugar"]
RECENCY_WORDS = ["最新", "近期", "latest", "recent", "new"]
