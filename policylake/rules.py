"""Vocabularies used by the extractors, as plain data.

Every operator takes its vocabulary as a parameter; the values here are the defaults. They are
small, fixed lists (bounded by this file), so they are compiled into Column expressions or
literal sets and never joined.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple


class Rule(NamedTuple):
    """A label and the keywords that trigger it, in matching order."""

    label: str
    keywords: tuple[str, ...]


class Weighted(NamedTuple):
    word: str
    weight: int


def parse_rules(block: str) -> tuple[Rule, ...]:
    """``label: kw kw kw`` per line."""
    rules = []
    for line in block.strip().splitlines():
        label, words = line.split(":", 1)
        rules.append(Rule(label.strip(), tuple(words.split())))
    return tuple(rules)


def parse_weights(block: str) -> tuple[Weighted, ...]:
    """``word weight`` per line."""
    pairs = (line.split() for line in block.strip().splitlines())
    return tuple(Weighted(word, int(weight)) for word, weight in pairs)


def parse_pairs(block: str) -> tuple[tuple[str, str], ...]:
    """``key value`` per line, order kept."""
    return tuple(tuple(line.split()) for line in block.strip().splitlines())


def words(block: str) -> tuple[str, ...]:
    return tuple(block.split())


# --- Fixed values: these lists decide the results and are stated as they are. ---------------

PROVINCE_NAMES = words(
    """
    北京 天津 河北 山西 内蒙古 辽宁 吉林 黑龙江 上海 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东
    广西 海南 重庆 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆 台湾 香港 澳门
    """
)

CATEGORY_RULES = parse_rules(
    """
    汽车: 汽车 乘用车 新能源车 置换更新 报废更新 车辆
    家电: 家电 冰箱 洗衣机 空调 电视 热水器 油烟机 灶具
    数码: 数码 手机 平板 电脑 笔记本 智能手表 耳机
    农机: 农机 农业机械 拖拉机 收割机 播种机
    家装: 家装 厨卫 适老化 家具 建材
    设备更新: 设备更新 工业设备 老旧电梯 营运货车 公交车
    """
)

PROGRAM_RULES = parse_rules(
    """
    消费品以旧换新: 消费品以旧换新
    汽车以旧换新: 汽车以旧换新 汽车置换更新 汽车报废更新
    家电以旧换新: 家电以旧换新
    数码产品购新: 数码产品购新 手机等数码产品 数码产品
    农机购置与应用补贴: 农机购置 农机补贴 农业机械购置
    大规模设备更新: 大规模设备更新 设备更新
    """
)

FUNDING_RULES = parse_rules(
    """
    中央财政/超长期特别国债: 超长期特别国债 中央财政资金 中央财政
    省级财政: 省级财政 省财政安排 省财政厅安排
    市级财政: 市级财政 市财政安排 市财政局安排
    中央与地方共同承担: 中央与地方 中央和地方 央地共担
    财政资金: 财政资金 财政部安排 财政部门安排
    未在原文中明确: 补贴资金由 资金来源
    """
)

CAP_UNIT_RULES = parse_rules(
    """
    元/件: 元/件 每件 每台 每部
    元/人: 元/人 每人
    元/户: 元/户 每户
    元/辆: 元/辆 每辆
    """
)
DEFAULT_CAP_UNIT = "元"
DEFAULT_CAP_UNIT_QUOTE = "默认按元计"

END_NOTE_RULES = (Rule("额度用完提前截止", words("额度用完 资金用完 先到先得 提前截止 预算用完")),)

TIER_WORDS = words("分档 一档 二档 三档 价格区间")
TIER_QUOTE = "文档中出现分档/价格区间表述"
REDUCTION_CAP_QUOTE = "满减券按单笔优惠上限理解"
RATE_EXCLUDED = words("增值税 税率 折旧率 利率")
CAP_EXCLUDED = words("工资 薪酬 罚款 价格 销售额")
NOT_STACKABLE_WORDS = words("不可叠加 不得叠加 不再叠加")
STACKABLE_WORDS = words("可叠加 叠加使用 可同时享受")
CONDITION_WORDS = words("条件 对象 要求 凭证 发票 本人 实名")

TITLE_LINE_WORDS = words("通知 方案 公告 细则 办法 政策 措施")
NEWS_TITLE_WORDS = words("新闻 发布会 吹风会 活动举行 视频解读 图解 一图读懂")
INTERPRETATION_TITLE_WORDS = words("政策解读 解读 问答 答记者问")
IMPLEMENTATION_TITLE_WORDS = words("实施细则 实施方案 工作方案 管理办法")
POLICY_TITLE_WORDS = words("通知 公告 政策 办法 补贴标准")
NATIONAL_TITLE_WORDS = words("全国 国务院 商务部 财政部 国家发展改革委")
CITY_EXCLUDED = words("自治区 财政 政府 委员会 商务局 发展和改革 通知 公告 专区 换新")

RELEVANCE_RULES = parse_weights(
    """
    消费品以旧换新 18
    国补 16
    以旧换新 13
    大规模设备更新 11
    报废更新 8
    置换更新 8
    购新补贴 8
    补贴实施细则 8
    补贴标准 7
    补贴 5
    补助 4
    实施细则 5
    申报 3
    汽车 3
    家电 3
    数码 3
    农机 3
    """
)
STRONG_WORDS = words("国补 消费品以旧换新 以旧换新 大规模设备更新 购新补贴")
TOPIC_WORDS = words("汽车 家电 数码 手机 平板 智能手表 农机 电动自行车 家装 厨卫")
TOPIC_COMPANION = "补贴"
POLICY_TYPES = words("policy implementation notice")
NEGATIVE_TITLE_WORDS = words("新闻 发布会 吹风会 活动举行 视频解读 图解 一图读懂 招聘 招标 中标 采购公告 培训 公示")
NEGATIVE_BODY_WORDS = words("记者 发布会 视频 直播 活动报道")

DISCOVERY_WORDS = words("以旧换新 补贴 设备更新 国补 实施细则 资金 通知 公告 方案 政策")
LINK_SCORE_WORDS = words("以旧换新 补贴 实施细则 政策 通知 公告 汽车 家电 数码 农机 电动自行车 家装 购新")
LINK_STRONG_WORDS = words("以旧换新 消费品以旧换新 国补 购新")
LINK_TOPIC_WORDS = words("汽车 家电 数码 手机 平板 农机 电动自行车 家装 厨卫")
LINK_MECHANISM_WORDS = words("补贴 实施方案 实施细则 政策")

# full name and short name, in lookup order
PROVINCES = parse_pairs(
    """
    北京市 北京
    天津市 天津
    上海市 上海
    重庆市 重庆
    河北省 河北
    山西省 山西
    辽宁省 辽宁
    吉林省 吉林
    黑龙江省 黑龙江
    江苏省 江苏
    浙江省 浙江
    安徽省 安徽
    福建省 福建
    江西省 江西
    山东省 山东
    河南省 河南
    湖北省 湖北
    湖南省 湖南
    广东省 广东
    海南省 海南
    四川省 四川
    贵州省 贵州
    云南省 云南
    陕西省 陕西
    甘肃省 甘肃
    青海省 青海
    内蒙古自治区 内蒙古
    广西壮族自治区 广西
    西藏自治区 西藏
    宁夏回族自治区 宁夏
    新疆维吾尔自治区 新疆
    台湾省 台湾
    香港特别行政区 香港
    澳门特别行政区 澳门
    """
)
MUNICIPALITIES = words("北京市 天津市 上海市 重庆市")
NATIONAL = "全国"
NATIONAL_SCOPE_WORDS = words("全国 国家层面 全国范围")

CITIES_BY_PROVINCE = parse_rules(
    """
    广东省: 广州市 深圳市 珠海市 汕头市 佛山市 韶关市 湛江市 肇庆市 江门市 茂名市 惠州市 梅州市 汕尾市 河源市 阳江市 清远市 东莞市 中山市 潮州市 揭阳市 云浮市
    浙江省: 杭州市 宁波市 温州市 嘉兴市 湖州市 绍兴市 金华市 衢州市 舟山市 台州市 丽水市
    江苏省: 南京市 无锡市 徐州市 常州市 苏州市 南通市 连云港市 淮安市 盐城市 扬州市 镇江市 泰州市 宿迁市
    安徽省: 合肥市 芜湖市 蚌埠市 淮南市 马鞍山市 淮北市 铜陵市 安庆市 黄山市 滁州市 阜阳市 宿州市 六安市 亳州市 池州市 宣城市
    福建省: 福州市 厦门市 莆田市 三明市 泉州市 漳州市 南平市 龙岩市 宁德市
    江西省: 南昌市 景德镇市 萍乡市 九江市 新余市 鹰潭市 赣州市 吉安市 宜春市 抚州市 上饶市
    山东省: 济南市 青岛市 淄博市 枣庄市 东营市 烟台市 潍坊市 济宁市 泰安市 威海市 日照市 临沂市 德州市 聊城市 滨州市 菏泽市
    河南省: 郑州市 开封市 洛阳市 平顶山市 安阳市 鹤壁市 新乡市 焦作市 濮阳市 许昌市 漯河市 三门峡市 南阳市 商丘市 信阳市 周口市 驻马店市
    湖北省: 武汉市 黄石市 十堰市 宜昌市 襄阳市 鄂州市 荆门市 孝感市 荆州市 黄冈市 咸宁市 随州市
    湖南省: 长沙市 株洲市 湘潭市 衡阳市 邵阳市 岳阳市 常德市 张家界市 益阳市 郴州市 永州市 怀化市 娄底市
    四川省: 成都市 自贡市 攀枝花市 泸州市 德阳市 绵阳市 广元市 遂宁市 内江市 乐山市 南充市 眉山市 宜宾市 广安市 达州市 雅安市 巴中市 资阳市
    贵州省: 贵阳市 六盘水市 遵义市 安顺市 毕节市 铜仁市
    云南省: 昆明市 曲靖市 玉溪市 保山市 昭通市 丽江市 普洱市 临沧市
    陕西省: 西安市 铜川市 宝鸡市 咸阳市 渭南市 延安市 汉中市 榆林市 安康市 商洛市
    甘肃省: 兰州市 嘉峪关市 金昌市 白银市 天水市 武威市 张掖市 平凉市 酒泉市 庆阳市 定西市 陇南市
    青海省: 西宁市 海东市
    """
)

# substring of the lower-cased URL and the province it stands for, in lookup order
URL_PROVINCES = parse_pairs(
    """
    beijing 北京市
    bj.gov.cn 北京市
    tianjin 天津市
    tj.gov.cn 天津市
    hebei 河北省
    shanxi 山西省
    nmg 内蒙古自治区
    liaoning 辽宁省
    jilin 吉林省
    hlj 黑龙江省
    shanghai 上海市
    jiangsu 江苏省
    zhejiang 浙江省
    anhui 安徽省
    fujian 福建省
    jiangxi 江西省
    shandong 山东省
    henan 河南省
    hubei 湖北省
    hunan 湖南省
    guangdong 广东省
    guangxi 广西壮族自治区
    hainan 海南省
    chongqing 重庆市
    sichuan 四川省
    guizhou 贵州省
    yunnan 云南省
    xizang 西藏自治区
    shaanxi 陕西省
    gansu 甘肃省
    qinghai 青海省
    ningxia 宁夏回族自治区
    xinjiang 新疆维吾尔自治区
    """
)

# title lookup order and host substrings of the jurisdiction correction
CORRECTION_PROVINCES = words(
    """
    内蒙古 黑龙江 新疆 西藏 广西 宁夏 北京 天津 河北 山西 辽宁 吉林 上海 江苏 浙江 安徽 福建 江西 山东
    河南 湖北 湖南 广东 海南 重庆 四川 贵州 云南 陕西 甘肃 青海
    """
)
CORRECTION_HOSTS = parse_pairs(
    """
    beijing 北京
    bj.gov.cn 北京
    tj.gov.cn 天津
    hebei 河北
    shanxi 山西
    nmg 内蒙古
    liaoning 辽宁
    jilin 吉林
    hlj 黑龙江
    shanghai 上海
    jiangsu 江苏
    zhejiang 浙江
    zj.gov.cn 浙江
    anhui 安徽
    fujian 福建
    jiangxi 江西
    shandong 山东
    henan 河南
    hubei 湖北
    hunan 湖南
    guangdong 广东
    guangxi 广西
    hainan 海南
    chongqing 重庆
    sichuan 四川
    guizhou 贵州
    yunnan 云南
    xizang 西藏
    shaanxi 陕西
    gansu 甘肃
    qinghai 青海
    ningxia 宁夏
    nx.gov.cn 宁夏
    xinjiang 新疆
    """
)
CORRECTION_NATIONAL_WORDS = words("全国 国务院 商务部 财政部 国家发展改革委 国家发改委")

# network, prefix length: addresses that are not public
RESERVED_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)
RESERVED_IPV6_EXACT = ("::1", "::")
RESERVED_IPV6_PREFIXES = words("fc fd fe8 fe9 fea feb")

TRACKING_KEYS = words("utm_ spm from source ref")

MIME_EXTENSIONS = parse_pairs(
    """
    text/html .html
    application/xhtml+xml .html
    application/pdf .pdf
    application/msword .doc
    application/vnd.openxmlformats-officedocument.wordprocessingml.document .docx
    application/json .json
    text/csv .csv
    text/plain .txt
    image/png .png
    image/jpeg .jpg
    image/tiff .tiff
    image/webp .webp
    """
)

LEVELS = words("national province city district other")
AMOUNT_TYPES = words("percent fixed tiered other unknown")
METRIC_TYPES = words("allocated_funds disbursed_funds driven_sales beneficiary_count other")
METRIC_LABELS = parse_pairs(
    """
    allocated_funds 已下达资金
    disbursed_funds 已发放金额
    driven_sales 带动销售额
    beneficiary_count 惠及人数
    other 其他统计
    """
)
VISIBLE_STATUSES = words("submitted in_review changes_requested approved")
SUBMITTABLE_STATUSES = words("draft changes_requested submitted in_review")
PENDING_STATUSES = words("submitted in_review")
LISTING_TITLE_PATTERN = (
    "(门户网站|网站$|政策文件$|政策_|通知公告$|国家级政策$|国家政策信息$|国家政策$|政策传递$|专题专栏$"
    "|政策专区$|政策解读$|大规模设备更新和消费品以旧换新$|商务局网站$|发展和改革委员会 - .*政策$)"
)

# --- end of fixed values ---------------------------------------------------------------------


def any_of(items: Sequence[str]) -> str:
    """Regex alternation of literal words."""
    return "(?:" + "|".join(re.escape(w) for w in items) + ")"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_literal(items: Sequence[str]) -> str:
    """SQL array of words: one constant in the plan instead of one node per word."""
    return "array(" + ", ".join(map(_quote, items)) + ")"


def pairs_literal(pairs: Sequence[tuple[str, str]]) -> str:
    """SQL array of ``struct<key, value>``."""
    return "array(" + ", ".join(f"named_struct('key', {_quote(k)}, 'value', {_quote(v)})" for k, v in pairs) + ")"


def rules_literal(rules: Sequence[Rule]) -> str:
    """SQL array of ``struct<label, keywords array>``."""
    return "array(" + ", ".join(f"named_struct('label', {_quote(label)}, 'keywords', {array_literal(kw)})" for label, kw in rules) + ")"


def weights_literal(rules: Sequence[Weighted]) -> str:
    """SQL array of ``struct<word, weight>``."""
    return "array(" + ", ".join(f"named_struct('word', {_quote(w)}, 'weight', {weight})" for w, weight in rules) + ")"
