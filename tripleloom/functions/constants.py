"""Fixed values the results depend on."""

# Type and relation names, English to Chinese.
TYPE_NAMES = {
    "ApplicationScenario": "应用场景",
    "DataStructure": "数据结构",
    "Algorithm": "算法",
    "Operation": "操作",
    "Complexity": "复杂度",
    "PrincipleOrProperty": "原理或属性",
}
EXPORT_TYPE_NAMES = {**TYPE_NAMES, "Concept": "概念", "Entity": "实体"}
RELATION_NAMES = {
    "hasComplexity": "具有复杂度",
    "uses": "使用",
    "variantOf": "是变体",
    "appliesTo": "适用于",
    "provides": "提供",
    "implementedAs": "实现为",
    "usedIn": "用于",
}
DISPLAY_RELATION_NAMES = {
    "hasComplexity": "基于...评估",
    "uses": "使用...结构",
    "variantOf": "属于...变体",
    "appliesTo": "适用于...场景",
    "provides": "提供...接口",
    "implementedAs": "实现...算法",
    "usedIn": "应用于...领域",
}

# Relation schema (head type, tail type, relation, index).
RELATION_SCHEMA = [
    ("Algorithm", "Complexity", "hasComplexity", 0),
    ("Algorithm", "DataStructure", "uses", 1),
    ("DataStructure", "DataStructure", "variantOf", 2),
    ("DataStructure", "ApplicationScenario", "appliesTo", 3),
    ("DataStructure", "Operation", "provides", 4),
    ("DataStructure", "Algorithm", "implementedAs", 5),
    ("Operation", "ApplicationScenario", "usedIn", 6),
]

# Keyword families that give a type to a name, tried in this order.
TYPE_KEYWORDS = [
    ("算法", ["排序", "搜索", "查找", "算法", "sort", "search", "algorithm"]),
    ("数据结构", ["栈", "队列", "链表", "树", "图", "数组", "堆", "表",
              "stack", "queue", "list", "tree", "graph", "array", "heap"]),
    ("应用场景", ["应用", "场景", "求解", "匹配", "application", "scenario"]),
    ("操作", ["插入", "删除", "查找", "遍历", "初始化", "扩容", "入栈", "出栈", "入队", "出队"]),
    ("复杂度", ["o(", "复杂度", "complexity", "时间", "空间"]),
    ("原理或属性", ["lifo", "fifo", "稳定性", "原地", "有穷性", "确定性", "最优"]),
]
DEFAULT_TYPE = "概念"

# Curation rules (source type, relation, target type[, new relation]).
DELETE_RULES = [
    ("ApplicationScenario", "appliesTo", "DataStructure"),
    ("Operation", "appliesTo", "Algorithm"),
    ("Complexity", "appliesTo", "DataStructure"),
    ("ApplicationScenario", "uses", "Algorithm"),
    ("Complexity", "uses", "DataStructure"),
]
RENAME_RULES = [
    ("DataStructure", "uses", "ApplicationScenario", "appliesTo"),
    ("Algorithm", "uses", "ApplicationScenario", "appliesTo"),
    ("DataStructure", "uses", "Operation", "appliesTo"),
]

# Context sentences by relation and types, then by relation, then for any relation.
CONTEXT_TEMPLATES = [
    ("appliesTo", "DataStructure", "ApplicationScenario", "{source}数据结构适用于{target}场景"),
    ("appliesTo", "Algorithm", "ApplicationScenario", "{source}算法适用于{target}场景"),
    ("appliesTo", "DataStructure", "Operation", "{source}数据结构支持{target}操作"),
    ("appliesTo", "Algorithm", "Operation", "{source}算法支持{target}操作"),
    ("uses", "Algorithm", "DataStructure", "{source}算法使用{target}数据结构"),
    ("uses", "Operation", "DataStructure", "{target}数据结构用于{source}操作"),
    ("uses", "DataStructure", "DataStructure", "{source}基于{target}实现"),
    ("variantOf", "DataStructure", "DataStructure", "{source}是{target}的变体"),
    ("variantOf", "Algorithm", "Algorithm", "{source}是{target}的变体"),
    ("hasComplexity", "Algorithm", "Complexity", "{source}算法的时间复杂度为{target}"),
    ("hasComplexity", "Operation", "Complexity", "{source}操作的时间复杂度为{target}"),
]
GENERIC_TEMPLATES = {
    "appliesTo": "{source}适用于{target}",
    "uses": "{source}使用{target}",
    "variantOf": "{source}是{target}的变体",
    "hasComplexity": "{source}的复杂度为{target}",
}
ANY_TEMPLATE = "{source}与{target}存在{relation}关系"

# Intents and the keywords of each, tried in this order.
INTENT_KEYWORDS = [
    ("find_relation_by_two_entities", ["关系", "联系", "区别", "差异", "相同", "不同", "比较"]),
    ("find_entity_by_relation_and_entity", ["有哪些", "包含", "属于", "类型", "分类", "种类"]),
    ("find_entity_definition", ["查询", "搜索", "找", "显示", "展示", "获取", "什么是", "介绍", "详细信息", "属性", "特点",
                                "定义", "有什么", "的", "复杂度", "算法", "数据结构", "排序"]),
]
OTHER_INTENT = "other"
LISTING_KEYWORDS = ["有哪些", "包含", "属于", "类型", "分类", "种类"]
LISTING_RELATION = "包含"
SCORING_WORDS = ["包含", "属于", "类型", "定义", "相关", "常用", "适用", "实现"]

# Display groups by type; any other type is group 6.
TYPE_GROUPS = {"算法": 1, "数据结构": 2, "策略": 3, "模式": 4, "概念": 5}
OTHER_GROUP = 6

# Patterns of unsafe input.
UNSAFE_PATTERNS = [r"[';]", r"\b(DROP|DELETE|CREATE|ALTER|MERGE)\b", r"//", r"/\*.*\*/"]

# Words and names dropped when candidates are resolved, and boosted when ranked.
ENTITY_STOPWORDS = ["排序", "树", "路径", "图", "算法"]
BOOSTED_ENTITIES = ["时间复杂度"]
NAMED_ENTITY = "NAMED_ENTITY"

# Fixed value: answer when no relation fits.
NO_RELATION = "无关系"

# Limits of the query surface.
HUB_DEGREE = 15
HUB_SHARE = 0.7
HUB_RELATION_COUNT = 10
