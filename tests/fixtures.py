"""Demo inputs and published outputs of the method, as literal test data."""

DEMO_TEXTS = [
    (1, "我已经多次反映小区垃圾分类设施不足，希望政府尽快处理。", 1),
    (2, "这个政策解释不清楚，居民不知道应该如何申请。", 0),
    (3, "我们愿意配合街道办开展社区宣传活动。", 1),
    (4, "政府回复非常具体，说明了办理流程和时间安排。", 1),
    (5, "我对目前的停车管理非常不满意，收费标准也不透明。", 0),
    (6, "希望相关部门能够调整现有政策，并公开解释申请条件。", 1),
    (7, "居民可以一起参与社区治理，我们愿意提供志愿服务。", 1),
    (8, "工作人员只是简单回复，没有说明解决方案。", 0),
    (9, "这个问题已经拖了很久，居民感到非常失望。", 0),
    (10, "街道办给出了明确方案，并承诺下周完成整改。", 1),
]

# Published score table: dissatisfaction, policy_demand, coproduction_request.
DEMO_SCORES = {
    1: (0.35199684, 0.3168381, 0.34441823),
    2: (0.2845416, 0.4056989, 0.27212542),
    3: (0.25123692, 0.29646832, 0.46974444),
    4: (0.14704832, 0.468101, 0.35642314),
    5: (0.33711767, 0.07658172, 0.019651722),
    6: (0.23604839, 0.6788424, 0.30087492),
    7: (0.30348313, 0.3664654, 0.7479905),
    8: (0.2312975, 0.13568276, 0.16162306),
    9: (0.41075063, 0.12920246, 0.032613333),
    10: (0.14524846, 0.40542006, 0.22789298),
}
CONDITIONS = ["dissatisfaction", "policy_demand", "coproduction_request"]

DEMO_PROTOTYPES = [
    ("dissatisfaction",
     "The citizen complains about a public problem or expresses dissatisfaction frustration disappointment anger or lack of transparency. 公民表达不满意、抱怨、投诉、失望、愤怒，指出问题长期没有解决、收费不透明、管理不合理、设施不足或政府处理不到位。",
     "condition"),
    ("policy_demand",
     "The citizen asks for policy clarification adjustment implementation or government action. 公民要求政府解释政策、调整政策、明确申请条件、改进执行流程或采取具体行动。",
     "condition"),
    ("coproduction_request",
     "The citizen shows willingness to cooperate participate volunteer or co-produce public services with government. 公民愿意配合政府、参与社区治理、提供志愿服务、共同完成公共服务或协助政策执行。",
     "condition"),
    ("responsiveness",
     "The government provides a clear concrete respectful and actionable response. 政府提供清楚、具体、尊重且可执行的回应，包括流程、时间安排、责任部门或解决方案。",
     "outcome"),
]

# Published fuzzy membership (anchors 0.15 / 0.35 / 0.45) for a few cases.
GOLDEN_FUZZY = {
    1: (0.5099842, 0.41709525, 0.486045575),
    3: (0.2530923, 0.3661708, 1.0),
    4: (0.0, 1.0, 0.5321157),
    9: (0.80375315, 0.0, 0.0),
}

# Published truth table at crisp threshold 0.30, in published row order.
GOLDEN_TRUTH_TABLE = [
    (0, 1, 0, "~dissatisfaction * policy_demand * ~coproduction_request", 2, 1, 0.5, 0.1667, "2, 10", "contradictory"),
    (0, 1, 1, "~dissatisfaction * policy_demand * coproduction_request", 2, 2, 1.0, 0.3333, "4, 6", "sufficient"),
    (1, 1, 1, "dissatisfaction * policy_demand * coproduction_request", 2, 2, 1.0, 0.3333, "1, 7", "sufficient"),
    (0, 0, 1, "~dissatisfaction * ~policy_demand * coproduction_request", 1, 1, 1.0, 0.1667, "3", "sufficient"),
    (1, 0, 0, "dissatisfaction * ~policy_demand * ~coproduction_request", 2, 0, 0.0, 0.0, "5, 9", "weak"),
    (0, 0, 0, "~dissatisfaction * ~policy_demand * ~coproduction_request", 1, 0, 0.0, 0.0, "8", "weak"),
]

GOLDEN_SOLUTION_SENTENCES = [
    "When the configuration [~dissatisfaction * policy_demand * coproduction_request] is present, the outcome occurs in 2 out of 2 observed case(s).",
    "When the configuration [dissatisfaction * policy_demand * coproduction_request] is present, the outcome occurs in 2 out of 2 observed case(s).",
    "When the configuration [~dissatisfaction * ~policy_demand * coproduction_request] is present, the outcome occurs in 1 out of 1 observed case(s).",
]

LABELED_DEMO = [
    ("L1", "居民对停车收费不透明非常不满，认为管理方式不合理。", 1, 0, 0),
    ("L2", "这个问题已经投诉很多次了，但一直没有得到解决。", 1, 0, 0),
    ("L3", "小区垃圾分类设施不足，居民对此感到失望。", 1, 0, 0),
    ("L4", "办理流程反复变化，群众非常不满意。", 1, 0, 0),
    ("L5", "工作人员回复敷衍，没有说明具体解决方案。", 1, 0, 0),
    ("L6", "请问申请补贴需要提交哪些材料？", 0, 1, 0),
    ("L7", "希望政府明确政策执行时间和申请条件。", 0, 1, 0),
    ("L8", "建议相关部门调整现有政策并公开解释原因。", 0, 1, 0),
    ("L9", "请说明为什么这个区域暂时不能办理业务。", 0, 1, 0),
    ("L10", "我们希望街道尽快出台具体整改方案。", 0, 1, 0),
    ("L11", "我们愿意配合社区开展志愿服务。", 0, 0, 1),
    ("L12", "居民可以一起参与垃圾分类宣传活动。", 0, 0, 1),
    ("L13", "我们愿意和街道共同讨论停车管理方案。", 0, 0, 1),
    ("L14", "社区志愿者可以协助政策宣传和秩序维护。", 0, 0, 1),
    ("L15", "我们愿意提供场地并协助组织居民会议。", 0, 0, 1),
    ("L16", "天气很好，今天社区活动正常举行。", 0, 0, 0),
    ("L17", "工作人员已经电话通知了办理时间。", 0, 0, 0),
    ("L18", "系统显示申请已经提交成功。", 0, 0, 0),
    ("L19", "居民收到了普通短信提醒。", 0, 0, 0),
    ("L20", "社区公告栏更新了本周值班安排。", 0, 0, 0),
    ("L21", "收费标准不透明，希望政府公开解释依据。", 1, 1, 0),
    ("L22", "我们对长期拖延不满，并要求尽快整改。", 1, 1, 0),
    ("L23", "居民愿意参与整改讨论，也希望政策更加清楚。", 0, 1, 1),
    ("L24", "虽然大家不满，但仍愿意配合街道一起解决问题。", 1, 0, 1),
    ("L25", "居民投诉设施不足，并愿意参加后续协商会议。", 1, 0, 1),
    ("L26", "希望明确申请条件，我们也可以协助宣传。", 0, 1, 1),
    ("L27", "对处理速度不满意，希望公布具体时间表。", 1, 1, 0),
    ("L28", "我们可以组织志愿者，但需要政府说明流程。", 0, 1, 1),
    ("L29", "居民不满当前管理方式，也愿意共同提出改进方案。", 1, 0, 1),
    ("L30", "请尽快解释政策变化，并邀请居民参与讨论。", 0, 1, 1),
]
