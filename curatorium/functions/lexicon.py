"""Word lists and expressions that results depend on, as they stand in the portal whose records are curated."""

MUNICIPALITIES = (
    "松山市", "今治市", "宇和島市", "八幡浜市", "新居浜市", "西条市", "大洲市", "伊予市", "四国中央市", "西予市",
    "東温市", "上島町", "久万高原町", "松前町", "砥部町", "内子町", "伊方町", "松野町", "鬼北町", "愛南町",
)
OTHER_PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県",
    "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県",
    "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県", "香川県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
NOT_MUNICIPALITIES = ("市町村", "市区町村", "町村", "都市", "地方都市", "中核市", "政令市", "市民", "市内", "市外", "市街地")
REGION_ELSEWHERE = "県・全国 (市町村指定なし)"

#: Values that stand for "missing", by the place they are used in.
MISSING = {
    "quality": ("不明", "未記載", "未設定", "要確認", "公式ページをご確認ください"),
    "period": ("公式ページをご確認ください", "不明", "未定", "更新日", "掲載日", "対象期間", "対象経費", "制度概要"),
    "exact": ("不明", "未定"),
    "title": ("不明", "未記載"),
}

#: Routes of the portal, first match wins.
ROUTES = (
    ("subsidy", "/subsidy/"), ("column", "/column/"), ("expert-articles", "/expert-articles/"), ("area", "/area/"), ("purpose", "/purpose/"),
    ("feature", "/feature/"), ("search", "/search"), ("admin", "/admin"), ("login", "/login"), ("dashboard", "/dashboard"),
)
SLUG_ROUTES = ("subsidy", "column", "expert-articles", "area", "purpose", "feature")
ASSET_EXTENSIONS = ("avif", "css", "gif", "ico", "jpeg", "jpg", "js", "json", "map", "png", "svg", "webmanifest", "webp", "xml")
LIKELY_MISSING = ("not-found", "does-not-exist", "should-not-exist", "999999999", "test-codex")
URL_HEADERS = ("url", "page", "ページ", "対象url")
TRACKING = {
    "crawl": ("utm_[^=&]*", "fbclid", "gclid", "yclid"),
    "index": ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"),
    "fetch": ("utm_source", "utm_medium", "utm_campaign"),
}
DENIED_SEGMENTS = r"/(?:login|admin|cart|contact|calendar)/"

ASSISTANCE = "補助金|助成金|補助事業|助成事業|補助制度|助成制度|支援金|給付金|奨励金|交付金|利子補給|医療費助成|住宅改修助成|旅客運賃助成|補助|助成"
PERSONAL_ASSISTANCE = "母子保健|不妊治療|妊産婦|医療費助成|先進医療|子ども医療|こども医療|住宅改修|移住|定住|空き家|離島|旅客運賃助成|高齢者|障がい者|障害者|福祉"
DETAIL_SIGNALS = ("申請期間", "受付期間", "募集期間", "対象経費", "助成対象", "補助対象", "補助率", "補助上限", "助成額", "補助額", "上限(?:額)?", "対象者", "対象事業", "交付対象")
INDEX_TITLES = ("一覧", "リンク集", "^補助金・助成金$", "^補助金$", "^助成金$", "^補助制度$", "^支援制度$", "各種補助", "各種補助制度", "事業者向け支援制度", "産業・商工業", "農林水産業", "目的別.*助成", "目的別", "くらしの情報", "産業")
NOISE = ("入札", "契約", "職員採用", "パブリックコメント", "統計", "議会", "認定申請", "児童手当", "介護保険", "証明書", "モニター募集", "アンケート", "審議会", "委員募集")
FORMS = ("申請書", "様式", "記入例", "記載例", "チェックリスト", "同意書", "委任状", "チラシ", "パンフレット", "説明資料", "(?i)shinseisho", "(?i)youshiki", "(?i)kisairei", "(?i)form")
GUIDELINES = ("募集要項", "公募要領", "交付要綱", "実施要領", "制度案内")

INCLUDED_LINKS = (
    "補助", "助成", "補助金", "助成金", "医療費助成", "住宅改修助成", "旅客運賃助成", "支援金", "奨励金", "支援事業", "助成事業", "補助事業", "公募", "募集",
    "交付金", "事業費補助", "導入支援", "促進事業", "整備事業",
)
EXCLUDED_LINKS = (
    "一覧", "リンク集", "サイトマップ", "例規", "申請書", "様式", "記入例", "入札", "契約", "職員採用", "パブリックコメント", "統計", "議会", "認定申請", "児童手当", "介護保険",
    "証明書", "モニター募集", "アンケート", "審議会", "委員募集", "申請書様式のみ", "記入例のみ", "Jグランツ", "jgrants",
)

#: Link scores: (field, expression, points, guard). Guards: weak (no strong assistance signal), no_interest (neither 利子補給 nor 補助), pdf.
LINK_RULES = (
    ("text", "補助(?!者|員|職員|事務|業務|作業)", 8, ""), ("text", "助成", 8, ""), ("text", "補助金", 8, ""), ("text", "助成金", 8, ""),
    ("text", "支援事業", 6, ""), ("text", "助成事業", 6, ""), ("text", "補助事業", 6, ""), ("text", "医療費助成", 5, ""), ("text", "住宅改修助成", 5, ""),
    ("text", "移住", 5, ""), ("text", "定住", 5, ""), ("text", "空き家", 5, ""), ("text", "支援金", 5, ""), ("text", "奨励金", 5, ""), ("text", "公募", 5, ""),
    ("text", "募集", 4, ""), ("text", "交付金", 4, ""),
    ("url", "(?i)hojokin", 4, ""), ("url", "(?i)hojyokin", 4, ""), ("url", "(?i)/hojo(?:/|\\.|_|-)", 4, ""), ("url", "(?i)josei", 4, ""), ("url", "(?i)shien", 4, ""),
    ("url", "(?i)business|sangyoshinko", 3, ""), ("url", "(?i)sangyou", 3, ""), ("url", "(?i)chusyou", 3, ""), ("url", "(?i)keizai", 3, ""), ("url", "(?i)nougyou", 3, ""),
    ("url", "(?i)kankou", 3, ""), ("url", "(?i)sougyou", 3, ""), ("url", "(?i)youkou|boshu|koubo|guideline", 3, "pdf"),
    ("heading", "補助金", 4, ""), ("heading", "助成金", 4, ""), ("heading", "中小企業", 3, ""), ("heading", "商工", 3, ""), ("heading", "産業", 2, ""), ("heading", "農業", 2, ""),
    ("heading", "観光", 2, ""), ("heading", "創業", 3, ""), ("heading", "支援制度", 3, ""),
    ("heading", "暮らし", -2, ""), ("heading", "税", -4, ""), ("heading", "戸籍", -4, ""), ("heading", "ごみ", -4, ""), ("heading", "消防", -3, ""), ("heading", "教育", -3, ""),
    ("heading", "子育て", -2, "weak"),
    ("text", "一覧", -10, ""), ("text", "リンク集", -10, ""), ("text", "サイトマップ", -10, ""), ("text", "例規", -10, ""), ("text", "申請書", -10, ""), ("text", "様式", -10, ""),
    ("text", "記入例", -10, ""), ("text", "認定申請", -15, "weak"), ("text", "手当", -15, "weak"), ("text", "児童手当", -15, "weak"), ("text", "介護保険|保険制度", -15, "weak"),
    ("text", "入札", -10, ""), ("text", "契約", -10, ""), ("text", "職員採用|会計年度任用職員|職員", -10, "weak"), ("text", "パブリックコメント", -10, ""), ("text", "統計", -10, "weak"),
    ("text", "取消|取り消し|取り消しました", -30, ""), ("text", "受付終了|募集終了", -6, ""), ("text", "報告|策定しました", -8, ""), ("text", "融資制度", -6, "no_interest"),
    ("text", "導入計画", -6, "weak"), ("text", "商品券|キャンペーン", -5, "weak"),
    ("url", "(?i)sitemap", -8, ""), ("url", "(?i)gikai", -8, ""), ("url", "(?i)nyusatsu", -8, ""), ("url", "(?i)keiyaku", -8, ""), ("url", "(?i)saiyou", -8, ""), ("url", "(?i)toukei", -8, ""),
    ("url", "(?i)form", -8, ""), ("url", "(?i)style", -8, ""), ("url", "(?i)shinseisho", -8, ""), ("url", "(?i)kisairei", -8, ""),
    ("url", "(?i)^https?://([^/?#]*\\.)?jgrants-portal\\.go\\.jp(?:[:/?#]|\\z)", -8, ""), ("url", "^#", -5, ""), ("url", "(?i)^(mailto|tel|javascript):", -5, ""),
    ("url", "(?i)\\.(?:jpe?g|png|gif|webp|svg|ico|zip|docx?|xlsx?|pptx?)\\z", -5, ""), ("text", "^.{1,2}\\z", -5, ""), ("url", "(?i)/(?:kenko|fukushi|kosodate)/", -4, "weak"),
)

#: What the reasons of a link's score show for a field, and for rules whose expression is not what they are called.
LINK_FIELDS = {"text": "link_text", "heading": "parent_heading", "url": "url"}
LINK_LABELS = {
    ("text", "補助(?!者|員|職員|事務|業務|作業)"): "link_text:補助", ("url", "(?i)/hojo(?:/|\\.|_|-)"): "url:/hojo", ("url", "(?i)business|sangyoshinko"): "url:business/sangyoshinko",
    ("url", "(?i)youkou|boshu|koubo|guideline"): "pdf_filename:youkou/boshu/koubo/guideline", ("text", "認定申請"): "link_text:認定申請のみ", ("text", "手当"): "link_text:手当のみ", ("text", "児童手当"): "link_text:児童手当のみ",
    ("text", "介護保険|保険制度"): "link_text:保険制度のみ", ("text", "職員採用|会計年度任用職員|職員"): "link_text:職員募集", ("text", "取消|取り消し|取り消しました"): "link_text:取消", ("text", "受付終了|募集終了"): "link_text:受付終了",
    ("text", "報告|策定しました"): "link_text:報告/策定", ("text", "融資制度"): "link_text:融資制度のみ", ("text", "導入計画"): "link_text:導入計画のみ", ("text", "商品券|キャンペーン"): "link_text:商品券/キャンペーン",
    ("url", "(?i)^https?://([^/?#]*\\.)?jgrants-portal\\.go\\.jp(?:[:/?#]|\\z)"): "url:jgrants-portal.go.jp", ("url", "^#"): "same_page_anchor", ("url", "(?i)^(mailto|tel|javascript):"): "invalid_scheme",
    ("url", "(?i)\\.(?:jpe?g|png|gif|webp|svg|ico|zip|docx?|xlsx?|pptx?)\\z"): "asset_or_non_page_file", ("text", "^.{1,2}\\z"): "link_text:短すぎる", ("url", "(?i)/(?:kenko|fukushi|kosodate)/"): "url:kenko/fukushi/kosodate without strong subsidy",
}

#: Page scores: (field, expression, points, guard).
PAGE_RULES = (
    ("title", "補助金", 8, ""), ("title", "助成金", 8, ""), ("title", "助成", 8, ""), ("title", "補助", 8, ""), ("title", "支援事業", 6, ""), ("title", "助成事業", 6, ""),
    ("title", "補助事業", 6, ""), ("title", "公募", 4, ""), ("title", "医療費助成", 5, ""), ("title", "住宅改修助成", 5, ""), ("title", "移住", 5, ""), ("title", "定住", 5, ""), ("title", "空き家", 5, ""),
    ("url", "(?i)hojokin", 3, ""), ("url", "(?i)josei", 3, ""), ("url", "(?i)shien", 3, ""),
    ("all", "対象者", 4, ""), ("all", "助成対象", 4, ""), ("all", "補助対象", 4, ""), ("all", "対象経費", 3, ""), ("all", "補助率", 3, ""), ("all", "申請期間|受付期間|募集期間", 4, ""),
    ("all", "助成額", 4, ""), ("all", "補助額", 4, ""), ("all", "上限", 3, ""), ("all", "募集要項", 2, "pdf"), ("all", "公募要領", 2, "pdf"),
    ("title", "一覧", -8, ""), ("title", "リンク集", -8, ""), ("title", "制度案内", -10, "weak"), ("title", "認定申請", -15, "weak"), ("title", "児童手当", -15, "weak"),
    ("title", "介護保険|保険制度", -15, "weak"), ("title", "モニター募集", -8, ""), ("url", "(?i)/index\\.html?\\z", -5, ""),
)

SUBSIDY_WORDS = "補助金|助成金|支援金|給付金|奨励金|交付金|利子補給|税制優遇"
VOUCHER = "円券|助成券|利用券|タクシー券|商品券|交通券|回数券|券面額|(?:[0-9]+|[一二三四五六七八九十]+)枚|1枚|一枚|1回|一回|1日|一日|月額|年額|交通費|運賃"
OPEN_NOW = "随時|受付中|募集中|予算に達し次第|予算額に達し次第|先着"
OPEN_ENDED = "助成枠に達するまで|予算に達するまで|予算額に達するまで|予算枠に達し次第|予算上限に達し次第|定員に達し次第|達し次第|なくなり次第|随時|通年|常時"
CLOSED = "受付終了|募集終了|公募終了|終了しました|募集は終了|受付は終了|申請受付を終了|終了いたしました"
BAD_PERIOD = "対象児童|出生|新生児|児童手当|住民登録|給付対象者|支給対象者|から今|から現在|より今|より現在|更新|更新日|お知らせ|一覧|忘れない"
EXPIRED_YEARS = "201[0-9]年|202[0-5]年|202[0-5]年度"
OPEN, CLOSED_STATUS, ANNOUNCED, UNKNOWN = "公募中", "受付終了", "予告", "不明"
INT4_MAX = 2147483647

#: Kinds of expenses, in the order they are looked for.
EXPENSES = (
    "機械装置費", "機械器具費", "設備・機器", "システム導入費", "ソフトウェア費", "クラウド利用料", "広告宣伝費", "展示会出展費", "専門家経費", "専門家謝金",
    "委託費", "外注費", "開発費", "試作費", "設計費", "工事費", "輸送費", "物流費", "運搬費", "原材料費", "材料費", "借料", "使用料", "賃借料", "印刷製本費",
    "通信運搬費", "消耗品費", "検査費", "認証取得費", "研修費", "翻訳費", "通訳費", "人件費", "旅費", "謝金", "設備費", "機器費", "広報費", "設備", "機器",
)
MACHINES = ("機械装置費", "機械器具費", "設備・機器")
NOT_EXPENSE = "補助率|助成率|上限|限度額|補助額|助成額|申請期間|受付期間|募集期間|[0-9]+分の[0-9]+|[0-9]+/[0-9]+|[0-9]+[%％]|円|切捨て|切り捨て"
MARKUP = "[<>=]|(?i:strong|span|style|class|div|href)"
EXPENSE_LABELS = ("対象経費", "補助対象経費", "助成対象経費", "対象となる経費")

#: Lines of pages that state a period, and those that state something else.
PERIOD_LABEL = "募集期間|申請期間|受付期間|公募期間|申請期限|受付期限|提出期限|募集期限|締切|締め切り|応募期間|応募期限"
PERIOD_HINT = "申請|受付|提出|応募|募集|公募|締切|締め切り|期限|申込|申し込み|請求|手続|電子申請|郵送|窓口"
PAGE_OPEN_ENDED = "助成枠に達するまで|予算額に達するまで|予算に達するまで|予算枠に達し次第|予算上限に達し次第|上限に達するまで|定員に達し次第|達し次第|なくなり次第|予算がなくなり次第|随時|常時|通年|期間の定めなし"
NOT_PERIOD = (
    "対象児童|給付対象者|支給対象者|対象者|対象となる児童|対象となる方|対象となる世帯|出生|生まれ|生年月日|新生児|児童|こども|子ども|児童手当|住民登録|受給者|給付対象|支給対象|給付額|支給額|年齢|扶養|所得|世帯"
    "|令和[0-9]+年[0-9]+月分|保護者|から今|から現在|から現時点|から今日|から本日|より今|より現在|以降今|以降現在"
)
DATE_LIKE = "令和|平成|20[0-9]{2}年|[0-9]{1,2}月\\s*[0-9]{1,2}日|随時|通年|達し次第|なくなり次第"
RANGE_LIKE = "～|〜|-|から|より|まで|随時|通年|達し次第|なくなり次第|期限|締切|締め切り"
START_ROW = "公募開始|募集開始|受付開始|申請受付開始|申請開始|公開開始"
ENDS_IN_ROW = "期限|締切|締め切り|まで|～|〜"
DEADLINE_ROWS = (
    ("(?:企画提案書|提案書|プロポーザル|企画書|応募書類|申請書).{0,30}(?:提出期限|提出締切|提出〆切|締切|期限)", 120),
    ("(?:参加申込書|参加申込|申込書|申込).{0,30}(?:提出期限|提出締切|提出〆切|締切|期限)", 70),
    ("提出期限|提出締切|提出〆切|応募期限|募集期限|受付期限|申請期限|締切|締め切り", 60),
)
OTHER_ROWS = "質問に対する回答|回答|審査|プレゼンテーション|結果通知|通知|説明会|ヒアリング|選定|審査結果|公表"
SHOWN_DATE = "令和[元0-9]+年\\s*[0-9]{1,2}月\\s*[0-9]{1,2}日(?:[（(][^）)]*[）)])?(?:\\s*(?:午前|午後)?\\s*[0-9]{1,2}時(?:[0-9]{1,2}分)?(?:\\s*まで)?|\\s*[0-9]{1,2}[:：][0-9]{2})?"
STATED_STATUS = ("予告", "受付終了", "公募中")

#: What a page's lines are taken for by their labels, and what makes an item of a list believable.
VALUE_LABELS = ("補助限度額", "助成限度額", "補助率", "助成率", "対象経費", "補助対象経費", "対象事業者", "対象者", "補助対象者", "助成対象者", "給付額", "支給額", "給付対象者", "支給対象者")
ENTITY_LABEL = "対象者|対象事業者|補助対象者|助成対象者|申請者|応募対象|対象となる方|対象企業|中小企業者|事業者の要件|給付対象者|支給対象者"
EXPENSE_LABEL = "対象経費|補助対象経費|助成対象経費|対象となる経費|補助対象事業|助成対象事業|対象事業|取組内容|対象となる取組"
EXPENSE_WORDS = (
    "経費|費用|事業|取組|取り組み|購入|導入|委託|工事|設備|システム|改修|削減|削減策|支援|開発|広告|広報|旅費|人件費|材料|備品|機器|調査|設計|施工|販路|研修|認証|検査|試験|製作|制作|印刷|出展"
)
ENTITY_WORDS = (
    "事業者|法人|個人事業主|中小企業|小規模|団体|農業者|漁業者|林業者|県内|市内|町内|本店|支店|営業所|店舗|施設|事務所|組合|会社|企業|創業者|生産者|世帯|保護者|児童|子ども|こども|受給者"
)
FIELD_NOISE = "更新|更新日|お知らせ|お忘れない|忘れない|一覧|新着|トップページ|ページ一覧|関連情報|くらし|生活|物価高対応|子育て応援手当|\\*|#|URL|http|https"
NOT_ITEM = "補助率|助成率|万円|上限|限度額|締切|募集期間|申請期間|問い合わせ|お問い合わせ"
BENEFIT = "給付金|給付|支給|手当|応援手当|子育て応援|児童手当"
URL_POINTS = (
    (r"(?i)pref\.ehime\.jp|city\.|town\.|lg\.jp|go\.jp|or\.jp", 10), ("(?i)j-net21|mirasapo|prtimes|hojyokin-portal|shienkin", -5), ("(?i)pdf", 1),
    ("(?i)apply|boshu|koubo|hojo|subsidy|shinsei|page|teate|kyufu", 2),
)

#: Hosts of municipalities.
MUNICIPALITY_HOSTS = (
    ("city.matsuyama.ehime.jp", "松山市"), ("city.imabari.ehime.jp", "今治市"), ("city.uwajima.ehime.jp", "宇和島市"), ("city.yawatahama.ehime.jp", "八幡浜市"), ("city.niihama.lg.jp", "新居浜市"), ("city.niihama.ehime.jp", "新居浜市"),
    ("city.saijo.ehime.jp", "西条市"), ("city.ozu.ehime.jp", "大洲市"), ("city.iyo.lg.jp", "伊予市"), ("city.iyo.ehime.jp", "伊予市"), ("city.shikokuchuo.ehime.jp", "四国中央市"), ("city.seiyo.ehime.jp", "西予市"), ("city.toon.ehime.jp", "東温市"),
    ("town.kamijima.lg.jp", "上島町"), ("kumakogen.jp", "久万高原町"), ("town.kumakogen.ehime.jp", "久万高原町"), ("town.masaki.ehime.jp", "松前町"), ("town.tobe.ehime.jp", "砥部町"), ("town.uchiko.ehime.jp", "内子町"), ("town.ikata.ehime.jp", "伊方町"),
    ("town.matsuno.ehime.jp", "松野町"), ("town.kihoku.ehime.jp", "鬼北町"), ("town.ainan.ehime.jp", "愛南町"),
)
PREFECTURE_HOST = "pref.ehime.jp"
OFFICIAL_PARTS = (".go.jp", ".lg.jp", ".or.jp", ".ehime.jp", "city.", "pref.", "town.")
PORTALS = (
    "hojyokin-portal.jp", "smart-hojokin.jp", "subsidy-el.jp", "biz-supporter.com", "tokyo-kosha.or.jp", "lycorp.co.jp", "yahoo.co.jp", "prtimes.jp", "note.com", "j-net21.smrj.go.jp", "mirasapo-plus.go.jp", "navinavi", "shikin-pro", "kamome-ops.com", "financeinjapan.com",
)
NO_VALUE = ("未記載", "不明", "未設定", "未具体化", "要確認")
MISSING_FIELDS = ("金額", "申請期間", "対象事業者", "対象経費", "補助率")
TITLE_FILLERS = "令和[0-9]+年度|令和|年度|補助金|補助事業|事業|支援"

#: Period texts that a crawl does not take.
CRAWL_NOT_PERIOD = (
    "補助金・助成金一覧|事業者向け支援制度|支援制度一覧|更新日|掲載日|お知らせ|忘れない|児童手当|対象児童|対象となる支出|支出が対象|対象経費|対象期間|対象となる事業|対象事業期間|実施した事業を対象|以降に実施した事業を対象|事業期間|補助対象期間|補助対象事業|申請方法|交付要綱|制度概要"
)
CRAWL_PERIOD = (
    "[0-9]{4}年|[0-9]{4}[-/][0-9]{1,2}|令和[0-9]+年|平成[0-9]+年|[一二三四五六七八九十元0-9]+月[0-9一二三四五六七八九十]+日|随時募集|随時受付|予算(?:額)?に達|予算上限|受付期間|募集期間|申請期限|締切|まで|通年"
)
SEE_OFFICIAL = "公式ページをご確認ください"
ENDED = "受付終了|募集終了|申請受付を終了|終了しました|終了いたしました|公募終了|助成終了|補助終了|現在受付していません|現在募集していません|今年度の受付は終了|予算上限に達したため終了"
SUSPENDED = "取扱いを休止|受付を休止|休止しています|休止中|取扱休止"
RUNNING = "令和8年度募集|令和8年度.*受付|令和8年.*受付|現在募集中|随時募集|随時受付|受付中|募集中"
ENDED_PERIOD = "令和[0-9]+年[0-9]+月[0-9]+日.*(?:助成終了|終了|まで)|20[0-9]{2}年[0-9]+月[0-9]+日.*(?:助成終了|終了|まで)"

#: Areas of a page: the elements whose links are looked at, in this order of preference, and the ones that surround what a page is about.
CONTENT_AREAS = ("main", "article", "#tmp_contents", "#contents", "#main", ".content", ".main", ".article", ".entry", ".body")
AREAS = {
    "navigation": (("header", "nav", ".global-nav", ".gnav", ".local-nav", ".sidemenu", ".side", ".sidebar", "#gnav", "#tmp_menu", "#tmp_lnavi"), "(?i)nav|gnav|menu|side|sidebar|lnavi|global"),
    "footer": (("footer", ".footer", "#footer", "#tmp_footer"), "(?i)footer|tmp_footer"),
    "breadcrumb": ((".breadcrumb", ".breadcrumbs", ".pankuzu", "#breadcrumb", "#tmp_pankuzu"), "(?i)breadcrumb|breadcrumbs|pankuzu|tmp_pankuzu"),
}
CONTEXT_AREAS = ("li", "tr", "section", "article", ".box", ".list", ".item", "div")

#: Lines of a page that say nothing about a programme: noise, the first line of what follows the text, and words of menus.
PAGE_NOISE = (
    "(?i)^!\\[.*?\\]\\(.*?\\)$|logo\\.png|search_title\\.png|JavaScriptが無効|文字の大きさ|背景色|音声読み上げ|検索|サイトマップ|ページの先頭|本文へ|閲覧支援|アクセシビリティ|新型コロナウイルス|職員採用|まじめえひめ|みきゃん"
    "|愛媛県庁公式ホームページ|愛媛県公式ホームページ|Foreign Language|Googleカスタム検索|現在地|トップページ|組織で探す|分野で探す|目的で探す|カレンダーで探す|更新日：|印刷用ページ|Tweet|LINEで送る|Facebook|Xでポスト"
)
PAGE_FOOTER = "このページに関するお問い合わせ先|お問い合わせ先|愛媛県庁$|法人番号|〒[0-9]{3}-[0-9]{4}|(?i:Copyright|All Rights Reserved)"
MENU_WORDS = ("検索", "組織", "分野", "目的", "防災", "観光", "県政", "採用", "入札", "相談", "申請")
IMPORTANT_WORDS = ("補助金", "助成金", "補助事業", "公募", "募集", "申請", "対象", "補助対象", "補助率", "補助額", "上限", "受付", "期間", "締切", "要領", "交付", "事業者", "愛媛県")
SECTION_WORDS = "概要|目的|対象|補助対象|申請|募集|公募|補助率|補助額|受付期間|提出先"
TITLE_PARTS = "年度|事業|補助|助成|公募|募集"

#: Editorial articles: kinds of articles and programmes, and what their titles and texts are searched for.
ARTICLE_TYPES = ("single_program", "feature", "feasibility_study", "equipment", "digital", "employment", "research", "marketing")
PROGRAM_KINDS = ("subsidy", "incentive", "benefit", "loan", "other")
ARTICLE_TYPE_LABELS = {
    "single_program": "個別制度記事", "feature": "特集記事", "feasibility_study": "FS・実現可能性調査", "equipment": "設備投資", "digital": "IT・デジタル化", "employment": "雇用・人材", "research": "研究開発", "marketing": "販路開拓",
}
PROGRAM_KIND_LABELS = {"subsidy": "補助金・助成金", "incentive": "奨励金", "benefit": "給付金・支援金", "loan": "融資・利子補給", "other": "その他の支援制度"}
ARTICLE_TYPE_WORDS = (
    ("feasibility_study", "(?i)FS\\s*調査|フィージビリティ|実現可能性調査|調査事業"), ("equipment", "設備投資|設備導入|省エネ|太陽光|蓄電池|機械"), ("digital", "(?i)IT|DX|デジタル|システム|ソフトウェア|AI|クラウド"), ("employment", "雇用|採用|人材|賃上げ|研修|リスキリング"),
    ("research", "研究|開発|実証|試作|技術開発"), ("marketing", "販路|販売促進|展示会|広告|PR|マーケティング|売上"),
)
PROGRAM_KIND_WORDS = (("incentive", "奨励金|立地奨励|企業立地|雇用奨励|立地促進"), ("benefit", "給付金|支援金|手当|商品券|給付事業"), ("loan", "融資|貸付|利子補給|信用保証料|保証料補助"), ("subsidy", "補助金|助成金|補助事業|助成事業"))
FEATURE = "特集"
PORTAL_HOST = "(?i)ehime-hojokin\\.jp"
PORTAL_PATHS = (
    "(?i)^/(?:$|[?#]|ehime-subsidy/?(?:[?#].*)?$|search(?:[?#].*)?$|simulator/?(?:[?#].*)?$|experts/?(?:[?#].*)?$|columns/?(?:[?#].*)?$|features/?(?:[?#].*)?$|beginners/?(?:[?#].*)?$|feature/[a-z0-9-]+/?(?:[?#].*)?$|purpose/[a-z0-9-]+/?(?:[?#].*)?$"
    "|area/[a-z0-9-]+/?(?:[?#].*)?$|column/[a-z0-9-]+/?(?:[?#].*)?$|subsidy/[0-9]+/?(?:[?#].*)?$)"
)
ARTICLE = {
    "year": "令和\\s*[0-9]+\\s*年度|20[0-9]{2}\\s*年",
    "amount": "補助率|上限額|補助上限|補助額|給付額|助成額|金額|上限",
    "money": "%|％|円|万円|千円|分の[一二三四五六七八九0-9０-９]|[0-9０-９]+\\s*/\\s*[0-9０-９]+|[0-9０-９]+\\s*割|以内",
    "official": "公式|募集要項|公募要領|交付要綱|自治体|実施機関|窓口|申請前|最新情報|確認日",
    "checked": "確認日|更新日|掲載日|参照日|閲覧日|令和\\s*[0-9]+\\s*年\\s*[0-9]+\\s*月|20[0-9]{2}[/-][0-9]{1,2}[/-][0-9]{1,2}|20[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日",
    "deadline": "締切|期限|申請期間|公募期間|受付期間|募集期間|第\\s*[0-9０-９一二三四五六七八九]+\\s*次\\s*公募",
    "deadline_detail": "締切|期限|申請期間|公募期間|受付期間|募集期間|開始|終了|必着|消印有効|令和\\s*[0-9]+\\s*年\\s*[0-9]+\\s*月|20[0-9]{2}[/-][0-9]{1,2}[/-][0-9]{1,2}|20[0-9]{2}年[0-9]{1,2}月[0-9]{1,2}日",
    "round": "第\\s*[0-9０-９一二三四五六七八九]+\\s*次|一次|二次|三次|四次|公募回|回次",
    "implementer": "実施機関|所管|事務局|主催|運営主体|自治体|国|県|市|町|村|愛媛県|経済産業省|中小企業庁|商工会議所|商工会",
    "offering": "第\\s*[0-9０-９一二三四五六七八九]+\\s*次\\s*公募|令和\\s*[0-9]+\\s*年度.{0,30}(補助金|助成金|給付金|支援事業|調査事業|補助事業)|[一-龥ぁ-んァ-ンA-Za-z0-9０-９・ー]{6,}(補助金|助成金|給付金|支援事業|調査事業|補助事業)",
    "generic": "一覧|まとめ|探し方|とは|解説|基礎|選び方|向けの補助金|使える補助金|補助金を探す",
    "study": "(?i)FS\\s*調査|フィージビリティ|実現可能性調査|調査事業",
    "study_detail": "調査計画|実現可能性|市場調査|事業化可能性|検証|調査費|専門家|委託調査|報告書|計画策定",
    "equipment": "設備投資|設備導入|機械導入|機器購入|設備購入|購入費|導入費|省エネ設備|生産設備|システム導入",
    "definite": "(補助率|上限額|補助上限|補助額|給付額|助成額|金額|令和\\s*[0-9]+\\s*年度|20[0-9]{2}\\s*年).{0,24}(です|となります|対象です|支給されます|補助されます|受けられます|使えます|利用できます)",
    "risky": "(必ず|絶対).{0,12}(対象|採択|受給|支給|受け取|もらえ|通る|使える)|誰でも.{0,12}(対象|もらえ|使える|受給|受け取)",
    "memo": "この記事の作成・確認方針|AIを下書き・整理に活用し、公開前に運営者が|本文内の外部確認リンク|本文内に外部リンクがない場合も|qualityScore|fatalIssues|shouldRegenerate|shouldHumanReview|管理用メモ",
    "local": "愛媛県|県内|松山市|今治市|宇和島市|新居浜市|西条市|大洲市|西予市|八幡浜市|四国中央市|商工会議所|商工会|地域事業者|えひめ補助金ポータル",
    "contract": "(申請前|交付申請前|交付決定前|事前着手届).{0,60}(契約|発注|購入|着手)|(?:契約|発注|購入|着手).{0,60}(申請前|交付申請前|交付決定前|事前着手届|制度ごと|公募要領|実施機関|確認)",
    "target": "対象者|対象になる|対象となる|対象の方|事業者|個人事業主|中小企業|法人|市町村|県内事業者",
    "expense": "対象経費|補助対象経費|経費|設備|購入|改修|委託|広告|人件費|旅費|受講費|システム|ソフトウェア|機器",
    "excluded": "対象外|対象にならない|対象外経費|注意が必要な経費|補助対象外",
    "action": "相談|診断|探す|確認する|問い合わせ|専門家|シミュレーター|次のステップ|公式ページで確認|補助金を探す|申請前に確認",
    "project": "対象事業|補助対象事業|取り組み|取組|事業内容|対象となる事業|支援対象事業",
    "conditions": "対象要件|交付要件|支給要件|立地要件|算定方法|交付条件|支給条件|申請条件",
    "start": "(契約|発注|購入|着手).{0,60}(制度ごと|交付決定前|事前着手|公募要領|実施機関|確認)|(?:交付決定前|事前着手届|公募要領).{0,60}(契約|発注|購入|着手|経費)",
    "industry_claim": "建設業、?製造業、?サービス業|建設業・製造業・サービス業|産業廃棄物処理業者|廃棄物処理業者|リサイクル業者",
    "expense_claim": "新規設備導入費|研修費|調査費|設備投資|新技術導入|環境対策費",
    "excluded_claim": "(中古品|人件費|管理費|着手済み経費).{0,24}(対象外|補助対象外|対象にならない)|(?:対象外|補助対象外).{0,24}(中古品|人件費|管理費|着手済み経費)",
    "excluded_fact": "中古品|人件費|管理費|着手済み経費",
    "fiction": "(?:株式会社|有限会社)[A-ZＡ-Ｚ](?:社)?|架空(?:の|事例|企業)|仮想事例|モデルケース|導入効果.{0,60}(?:円|万円|億円)",
    "number_claim": "(補助率|上限額|補助上限|補助額|給付額|助成額|金額|申請締切|締切|公募期間|受付期間|令和\\s*[0-9]+\\s*年度|20[0-9]{2}\\s*年).{0,40}?(%|％|円|万円|千円|令和\\s*[0-9]+\\s*年|20[0-9]{2}[/-][0-9]{1,2}|20[0-9]{2}年[0-9]{1,2}月|[0-9]{1,3}\\s*/\\s*[0-9]{1,3}|[0-9]+\\s*割)",
    "single": "この補助金|この制度|上限額が設定されています|一定の補助率が適用されます|令和\\s*[0-9]+\\s*年度においても実施されています|20[0-9]{2}\\s*年においても実施されています",
    "rate_title": "補助率",
    "cap_title": "上限額|補助上限|補助額|給付額|助成額|上限",
    "any_amount_title": "金額",
    "method": "算定方法|算定基準|計算方法",
    "evidence": "タイトル|機関|実施機関|概要|対象|経費|上限|締切|募集|公募|確認日|交付要綱|公募要領",
    "claimed_field": "対象者|対象業種|対象経費|対象外経費",
    "checklist": "(?i)チェックリスト|確認リスト|<ul[\\s>]|<ol[\\s>]",
}
REQUIRED_FACTS = {
    "single_program": ("officialName", "administeringBody", "officialSources", "eligibleApplicants"), "feature": ("officialSources",), "feasibility_study": ("officialSources", "eligibleProjects"), "equipment": ("officialSources", "eligibleExpenses"),
    "digital": ("officialSources", "eligibleExpenses"), "employment": ("officialSources", "eligibleApplicants"), "research": ("officialSources", "eligibleProjects"), "marketing": ("officialSources", "eligibleProjects"),
}
REQUIRED_OF_PROGRAM = {
    "subsidy": ("eligibleExpenses", "fundingDetails"), "incentive": ("eligibilityConditions", "calculationMethod"), "benefit": ("eligibilityConditions", "paymentConditions"), "loan": ("eligibilityConditions", "fundingDetails"), "other": ("programDetails", "fundingDetails"),
}
FACT_LABELS = {
    "officialName": "具体的な制度名", "administeringBody": "実施機関", "officialSources": "公式URLと根拠メモ", "eligibleApplicants": "対象者", "eligibleProjects": "対象事業", "eligibleExpenses": "対象経費", "eligibilityConditions": "交付・支給要件", "calculationMethod": "算定方法",
    "paymentConditions": "支給条件", "fundingDetails": "補助率・上限額・算定方法のいずれか", "programDetails": "対象事業・交付要件・対象経費のいずれか", "subsidyRate": "補助率", "subsidyCap": "上限額", "applicationDeadline": "申請期間・締切",
}

#: Texts of details: what counts as no value, labels that introduce a section, and the ones whose sections are looked for.
UNKNOWN_WORDS = ("", "-", "ー", "—", "不明", "未設定", "なし", "該当なし", "n/a", "na", "null", "undefined")
SECTION_LABELS = (
    "制度名", "補助金のキャッチコピー", "キャッチコピー", "目的", "概要", "制度の概要", "事業の目的", "対象事業者", "対象者", "補助対象者", "対象経費", "補助対象経費", "申請期間", "募集期間", "公募期間", "受付期間", "提出期限", "お問い合わせ", "連絡先", "提出先", "提出方法", "参照ホームページ", "公式URL", "詳細URL",
)

#: Values of an extraction that may replace a stored one.
NO_AMOUNT = ("", "不明", "未定", "なし", "無し", "null", "undefined", "-", "ー")
REFERENCE_ONLY = "参照|要領|サマリー|公募要領|公式|確認|別紙|募集要項"
DATED = "[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|令和[0-9]+年[0-9]{1,2}月[0-9]{1,2}日|令和[元一二三四五六七八九十]+年[0-9]{1,2}月[0-9]{1,2}日"
TITLE_LIKE = "補助金|助成金|給付金|支援金|事業|支援|導入|設備|公募|令和|年度"
UNDATED_PERIOD = "随時|通年|予算に達し次第|受付中|募集中|期限なし"
KNOWN_REGION = "全国|愛媛|四国|松山市|今治市|宇和島市|八幡浜市|新居浜市|西条市|大洲市|伊予市|四国中央市|西予市|東温市|上島町|久万高原町|松前町|砥部町|内子町|伊方町|松野町|鬼北町|愛南町"
CONCRETE_RATE = "[0-9０-９]+分の[0-9０-９]+|[0-9０-９]+/[0-9０-９]+|[0-9０-９]+%|[0-9０-９]+％|定額|全額|以内|以下"
