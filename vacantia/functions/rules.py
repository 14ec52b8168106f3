"""Rule data. Everything here is a fixed value that results depend on, stated as text."""

from __future__ import annotations


def _terms(text: str) -> tuple[str, ...]:
    """Comma-separated terms, each once, in the order given."""
    return tuple(dict.fromkeys(t.strip() for t in " ".join(text.split()).split(",") if t.strip()))


# ---- fixed values: eligibility of a location

UK_NATIONS = _terms("england, scotland, wales, northern ireland")
UK_COUNTRY = _terms("united kingdom, great britain, remote uk, hybrid uk, uk, u.k., gb, gbr")
UK_PLACES = _terms("""
london, manchester, birmingham, leeds, edinburgh, glasgow, bristol, cardiff, belfast, liverpool, sheffield, newcastle,
nottingham, leicester, coventry, brighton, oxford, cambridge, bath, york, reading, southampton, portsmouth,
exeter, plymouth, derby, stoke, wolverhampton, hull, sunderland, middlesbrough, durham, carlisle, chester,
peterborough, northampton, luton, swindon, bournemouth, poole, basingstoke, guildford, woking, slough, watford,
hemel hempstead, st albans, st. albans, welwyn, stevenage, hatfield, harlow, chelmsford, ipswich, norwich, lincoln,
worcester, gloucester, hereford, shrewsbury, telford, warrington, bolton, rochdale, wigan, oldham, stockport,
salford, huddersfield, bradford, wakefield, halifax, doncaster, rotherham, barnsley, grimsby, scunthorpe,
aberdeen, dundee, inverness, stirling, perth, paisley, derry, lisburn, swansea, newport, wrexham,
truro, yeovil, taunton, barnstaple, torquay, salisbury, winchester, chichester, crawley, horsham, haywards heath,
eastbourne, hastings, folkestone, dover, maidstone, tunbridge wells, colchester, southend, basildon,
wokingham, bracknell, farnborough, aldershot, milton keynes, aylesbury, banbury,
knutsford, macclesfield, crewe, nantwich, leamington spa, rugby, nuneaton,
gateshead, south shields, hartlepool, teesside, stockton,
canary wharf, city of london, croydon, richmond, twickenham, wimbledon, stratford, shoreditch, islington, hackney,
hammersmith, fulham, chelsea, kensington, whitechapel, greenwich, lewisham, bromley, sutton, kingston,
london ec, london wc, london e1, london e14, london se1, london n1, london w1,
midlands, west midlands, east midlands, yorkshire, lancashire,
cornwall, devon, somerset, dorset, east anglia, suffolk, norfolk,
home counties, south east, south west, north east, north west,
cotswolds, chilterns, pennines, highlands, lowlands, borders, east of england,
jersey, guernsey, isle of man,
radbroke, paddington, victoria, waterloo, euston, king's cross, kings cross, london bridge""")

BLOCKED_PLACES = _terms("""
india, canada, australia, singapore, germany, france, netherlands, spain, poland, uae, dubai, israel,
sweden, norway, denmark, finland, switzerland, austria, belgium, italy, portugal, czech republic, hungary, romania,
south korea, japan, china, hong kong, malaysia, thailand, new zealand, south africa, brazil, argentina, mexico,
ukraine, russia, dublin, ireland,
alabama, alaska, arizona, arkansas, california, colorado, connecticut, delaware, florida, georgia, hawaii, idaho,
illinois, indiana, iowa, kansas, kentucky, louisiana, maine, maryland, massachusetts, michigan, minnesota,
mississippi, missouri, montana, nebraska, nevada, new hampshire, new jersey, new mexico, new york, north carolina,
north dakota, ohio, oklahoma, oregon, pennsylvania, rhode island, south carolina, south dakota, tennessee, texas,
utah, vermont, virginia, washington, west virginia, wisconsin, wyoming,
new york, san francisco, los angeles, chicago, boston, seattle, austin, dallas, houston, atlanta, miami,
denver, portland, phoenix, las vegas, minneapolis, amsterdam, berlin, munich, paris, madrid, barcelona,
rome, milan, brussels, vienna, zurich, geneva, stockholm, oslo, copenhagen, helsinki, warsaw, prague,
budapest, bucharest, lisbon, luxembourg, tokyo, beijing, shanghai, seoul, taipei, bangkok,
jakarta, manila, kuala lumpur, ho chi minh, mumbai, delhi, bangalore, bengaluru, pune, chennai,
hyderabad, kolkata, noida, gurugram, gurgaon, ahmedabad, toronto, vancouver, montreal, sydney, melbourne, brisbane,
auckland, johannesburg, cape town, abu dhabi, riyadh, doha, tel aviv, whippany, mclean, plano, wilmington""")
GLOBAL_SIGNALS = _terms("global, worldwide, international, emea, remote")

# ---- fixed values: the earlier location predicates

V1_COUNTRIES = ("UK", "United Kingdom", "GB", "GBR", "GBI", "GBRE", "Great Britain", "Rest of UK", "Remote", "Multi-location", "Multilocation", "UK-wide")
V1_PLACES = _terms("""
london, manchester, birmingham, leeds, glasgow, edinburgh, bristol, liverpool, nottingham, sheffield, cardiff, belfast,
newcastle, cambridge, oxford, reading, brighton, southampton, coventry, leicester, york, bath, milton keynes, derby,
portsmouth, exeter, plymouth, aberdeen, dundee, stoke, luton, swindon, warrington, bolton, rochdale, sunderland,
guildford, woking, slough, watford, harlow, basildon, chelmsford, ipswich, peterborough, northampton, worcester,
gloucester, hereford, shrewsbury, telford, chester, carlisle, durham, middlesbrough, hull, lincoln, swansea, newport,
inverness, stirling, perth, derry, lisburn, truro, salisbury, winchester, chichester, crawley, horsham,
richmond, twickenham, wimbledon, croydon, canary wharf, city of london, knutsford, radbroke,
wokingham, bracknell, basingstoke, aldershot, farnborough, bournemouth, poole, dorchester, weymouth, yeovil,
taunton, barnstaple, torquay, paignton, newquay, midlands, yorkshire, lancashire, cornwall, devon, east anglia,
home counties, south east, south west, north east, north west, cotswolds, chilterns, pennines, highlands, lowlands,
jersey, guernsey, isle of man, london ec, london wc, london e1, london e14, london se1,
st. albans, st albans, stratford-upon-avon, stratford upon avon""")
V1_IRISH = _terms("""
cork, galway, limerick, waterford, wexford, kilkenny, drogheda, swords, bray, ennis, tralee, carlow, clonmel,
mullingar, sligo, athlone, republic of ireland, eire""")
V1_BLOCKS = _terms("""
ukraine, new york, new jersey, new south wales, new england, united states, usa, india, canada, australia, germany,
france, netherlands, singapore, hong kong, dubai, massachusetts, california, texas, florida, washington state""")
V1_CODES = _terms("""
us, usa, ny, nj, ca, tx, ma, il, wa, fl, ga, nc, va, pa, oh, mi, mn, co, az, or, nv, md, vt, nh, me, ct, ri, ky, tn, sc,
al, ms, la, ar, ok, ks, ne, sd, nd, mt, wy, id, ut, nm""")
V2_WORDS = _terms("""
uk, uki, uk&i, united kingdom, gb, england, scotland, wales, london, manchester, birmingham, edinburgh, bristol,
cambridge, oxford, glasgow, leeds, sheffield, newcastle, cardiff, liverpool, nottingham, reading, brighton,
southampton, belfast, coventry, northampton, milton keynes, remote - uk, uk remote, richmond, halifax, sunderland,
leicester, chester, basingstoke, knutsford, canary wharf, radbroke, gloucester, solihull, warwick, bromley, southend,
hove, purley, gildersome, portishead, pendeford, barnwood""")
V3_COUNTRIES = _terms("uk, united kingdom, gb, gbr, great britain")
V3_CITIES = _terms("""
london, manchester, birmingham, leeds, glasgow, edinburgh, bristol, liverpool, nottingham, sheffield, cardiff, belfast,
newcastle, cambridge, oxford, reading, brighton, southampton, coventry, leicester, york, bath, milton keynes, derby,
portsmouth, exeter, plymouth, aberdeen, dundee, stoke, luton, swindon, warrington, bolton, rochdale, sunderland""")
V4_WORDS = _terms("""
uk, united kingdom, london, gb, england, scotland, wales, northern ireland, remote - uk, belfast, edinburgh, manchester,
bristol, cambridge, oxford, glasgow, leeds, birmingham, knutsford, radbroke, northampton, halifax, milton keynes,
chester, liverpool, sheffield, newcastle, cardiff, swansea, nottingham, southampton, reading, brighton, bournemouth,
poole, jersey, isle of man, guernsey, city of london, canary wharf, lanarkshire""")
VERDICT_WORDS = _terms("""
united kingdom, uk, england, scotland, wales, northern ireland, london, manchester, birmingham, edinburgh, bristol, leeds, glasgow""")
CLEANUP_BLOCKS = _terms("""
ukraine, new york, new jersey, united states, usa, india, canada, australia, germany, france, ireland, dublin, paris,
berlin, amsterdam, massachusetts, washington, texas, california, chicago, hong kong, singapore, sydney, tokyo""")
CLEANUP_CODES = _terms("us, ny, nj, ca, tx, ma, il, wa, fl")
CLEANUP_RESCUES = _terms("uk, united kingdom, london")
LIKELY_BLOCKED = _terms("""
united states, usa, u.s.a, canada, india, australia, new zealand, germany, france, netherlands, spain, portugal, italy,
sweden, norway, denmark, finland, switzerland, austria, belgium, poland, ukraine, russia, china, japan, south korea,
singapore, hong kong, united arab emirates, dubai, israel, ireland, eire,
new york, new jersey, san francisco, los angeles, seattle, chicago, boston, austin, dallas, houston, denver, atlanta,
miami, phoenix, las vegas, san jose, san diego, whippany, wilmington, st louis, new hampshire, california, texas,
virginia, mclean, richmond, plano, georgia, illinois, maryland, pennsylvania, north carolina,
auckland, tokyo, berlin, munich, hamburg, paris, amsterdam, madrid, barcelona, stockholm, oslo, copenhagen,
zurich, geneva, vienna, warsaw, prague, bucharest, budapest, milan, rome, lisbon, brussels, luxembourg, mexico city,
pune, mumbai, bengaluru, bangalore, chennai, hyderabad, noida, gurgaon, gurugram, delhi, kolkata, ahmedabad, jaipur""")
UK_URL_HINTS = _terms("""
/uk/, united-kingdom, country=gb, country=uk, location=uk, locale=en-gb, countryid=gbr, country%5b%5d=gbr, country=gbr,
city=london, city=manchester, city=birmingham, city=leeds, city=bristol, city=liverpool,
city=edinburgh, city=glasgow, city=cardiff, city=belfast, /en-gb/, -gb-, region=uk, region=gb""")
NON_UK_URL_HINTS = _terms("""
country=us, country=usa, country=ca, country=au, country=sg, country=in, location=united-states, location=usa, location=us,
city=new-york, city=san-francisco, city=seattle, city=toronto, city=singapore, country=ie, country=de, country=fr""")
AMBIGUOUS = _terms("""
remote, flexible, hybrid, anywhere, worldwide, global, distributed, not specified, remote other, remot other,
multiple locations, location negotiable, negotiable, tbd, to be confirmed, various, various locations, see description,
see job description""")
WIDE_AREAS = _terms("emea, europe, global, worldwide, international, western europe, northern europe, british isles")
VAGUE_PLACES = _terms("""
location negotiable, negotiable, tbd, to be confirmed, various, various locations, see description, see job description,
multiple locations, not specified""")
SAMPLE_VAGUE = _terms("""
remote, flexible, hybrid, anywhere, worldwide, global, distributed, not specified, location negotiable, negotiable, tbd,
various, see description""")

# ---- fixed values: titles, in order of precedence (patterns between word boundaries unless they begin with ~)

LEVELS = (
    ("Executive", "chief|cto|ceo|cfo|coo|cpo|president|managing director|md"),
    ("VP", "~{vp}|vice president"),  # the phrase also within other words
    ("Director", "director"),
    ("Principal", "principal"),
    ("Lead", "lead"),
    ("Senior", "senior|sr"),
    ("Staff", "staff"),
    ("Internship", "intern|internship|placement|apprentice|apprenticeship"),
    ("Graduate", "graduate|entry.?level|early career|new grad|associate"),
    ("Junior", "junior|jr"),
)
DEFAULT_LEVEL = "Mid-level"
SECTORS = (
    ("Engineering (Software)", "software|developer|frontend|backend|fullstack|full.stack|ios|android|devops|cloud|sre|machine learning|ml engineer|ai engineer"),
    ("Engineering (Hardware)", "hardware|electrical|electronics|mechanical|manufacturing|firmware|embedded"),
    ("Data", "data|analytics|statistics|sql|python|bi|business intelligence"),
    ("Finance", "finance|accounting|tax|audit|financial|quant|trading|investment|treasury"),
    ("Healthcare", "health|medical|clinical|nurse|doctor|pharma|biotech|physician|therapist"),
    ("Legal", "legal|counsel|lawyer|attorney|solicitor|compliance|paralegal"),
    ("Marketing & PR", "marketing|brand|content|social media|communications|seo|growth|public relations"),
    ("Design", "design|ui|ux|product designer|graphic|creative"),
    ("Product Management", "product manager|product management|product owner"),
    ("Project Management", "project manager|programme|program manager|scrum|agile|delivery manager"),
    ("Sales & Partnerships", "sales|partnerships|business development|account executive|bdr|sdr|revenue"),
    ("Customer Success", "customer success|customer support|account manager|client success"),
    ("HR / People", "hr|human resources|people ops|talent|recruiter|recruiting|people partner"),
    ("Operations", "operations|logistics|supply chain|facilities|admin"),
    ("Research (Non-technical)", "market research|user research|insights analyst"),
    ("Research (Technical)", "research|scientist|r&d|phd|investigator"),
    ("Media & Journalism", "media|journalism|writer|editor|reporter|news|broadcast"),
    ("Engineering (Other)", "engineer|engineering"),
    ("Business & Strategy", "business|strategy|consultant|analyst|corporate|planning"),
)
JUNK_TITLES = _terms("""
see all jobs, view all jobs, all jobs, all openings, join our team, back to search, back to job list, search for jobs,
explore opportunities, show more, filter by, sort by, cookie policy, privacy policy, terms of use, contact us, about us,
careers home, learn more, get started, apply now, view details, view job, read more, open positions, current openings,
our roles, work with us, explore careers, early careers, experienced hires, alumni, jobs and careers, careers,
our vacancies, view vacancies""")

# ---- fixed values: preferences

REST_OF_UK = ("Manchester", "Birmingham", "Leeds", "Glasgow", "Sheffield", "Bristol", "Liverpool", "Newcastle", "Nottingham", "Southampton", "Reading")
TYPE_WORDS = {
    "Internship": _terms("intern, placement, internship, student, graduate"),
    "Placement scheme": _terms("placement, scheme, internship"),
    "Part-time": _terms("part-time, part time, hourly, flexible"),
    "Full-time": _terms("full-time, full time, permanent"),
}
SECTOR_WORDS = {
    "Business & Strategy": _terms("business, strategy, consultant, analyst, corporate, planning"),
    "Customer Success": _terms("customer, success, support, account, client"),
    "Data": _terms("data, analytics, statistics, machine learning, ai, sql, python, bi, business intelligence"),
    "Design": _terms("design, ui, ux, product designer, graphic, creative, art"),
    "Engineering (Hardware)": _terms("hardware, electrical, electronics, mechanical, manufacturing, firmware"),
    "Engineering (Other)": _terms("engineering, engineer, civil, chemical, biomedical, systems"),
    "Engineering (Software)": _terms("software, developer, engineer, frontend, backend, fullstack, ios, android, web, devops, cloud"),
    "Finance": _terms("finance, accounting, tax, audit, financial, quant, trading, investment"),
    "Healthcare": _terms("health, medical, clinical, nurse, doctor, pharma, biotech"),
    "HR / People": _terms("hr, human resources, people, talent, recruiter, recruiting, acquisition"),
    "Legal": _terms("legal, counsel, lawyer, attorney, law, compliance"),
    "Marketing & PR": _terms("marketing, pr, public relations, brand, content, social media, communications, seo, growth"),
    "Media & Journalism": _terms("media, journalism, writer, editor, reporter, news, broadcast"),
    "Operations": _terms("operations, logistics, supply chain, facilities, admin"),
    "Other": (),
    "Product Management": _terms("product, pm, product manager, owner"),
    "Project Management": _terms("project, program, scrum, agile, delivery"),
    "Research (Non-technical)": _terms("research, market research, user research, ur"),
    "Research (Technical)": _terms("research, r&d, scientist, phd, investigator"),
    "Sales & Partnerships": _terms("sales, partnerships, bd, business development, account executive, bdr, sdr"),
}
ALLOWED_TYPES = ("Full-time", "Part-time", "Internship", "Placement scheme")
ALLOWED_LOCATIONS = ("London", "Rest of UK", "Scotland", "Wales")
ALLOWED_SECTORS = tuple(SECTOR_WORDS)

# ---- fixed values: applicant-tracking providers

#: (part of the host, provider, where the token is): path = first path part, sub = first host label,
#: path_sub = path, else sub.
HOST_RULES = (
    ("ashbyhq.com", "ashby", "path"), ("lever.co", "lever", "path"), ("workable.com", "workable", "sub"), ("teamtailor.com", "teamtailor", "sub"),
    ("bamboohr.com", "bamboohr", "sub"), ("smartrecruiters.com", "smartrecruiters", "path_sub"), ("pinpointhq.com", "pinpoint", "sub"),
    ("breezy.hr", "breezy", "sub"), ("recruitee.com", "recruitee", "sub"), ("jobs.personio.de", "personio", "sub"), ("jobs.personio.com", "personio", "sub"), ("icims.com", "icims", "sub"),
)
HOST_PROVIDERS = (
    ("ashbyhq.com", "ashby"), ("lever.co", "lever"), ("greenhouse.io", "greenhouse"), ("workable.com", "workable"), ("teamtailor.com", "teamtailor"),
    ("bamboohr.com", "bamboohr"), ("smartrecruiters.com", "smartrecruiters"), ("pinpointhq.com", "pinpoint"), ("breezy.hr", "breezy"), ("recruitee.com", "recruitee"),
    ("personio.de", "personio"), ("myworkdayjobs.com", "workday"), ("workdayjobs.com", "workday"), ("oraclecloud", "oracle_cloud"), ("successfactors.com", "successfactors"),
    ("hibob.com", "hibob"), ("rippling.com", "rippling"), ("icims.com", "icims"),
)
LIKELY_NAMES = _terms("greenhouse, workable, lever, ashby, teamtailor, bamboohr, breezy, smartrecruiters, icims, workday, personio, pinpoint, jobvite, avature")
PATTERN_PROVIDERS = (
    ("greenhouse", r"greenhouse\.io"), ("lever", r"lever\.co"), ("ashby", "ashby"), ("workable", "workable"), ("bamboohr", "bamboohr"), ("teamtailor", "teamtailor"),
    ("smartrecruiters", "smartrecruiters"), ("workday", r"myworkdayjobs\.com"), ("icims", r"icims\.com"), ("jobvite", "jobvite"), ("breezy", r"breezy\.hr"), ("recruitee", "recruitee"), ("pinpoint", "pinpoint"),
)
#: Fingerprints in order of provider priority: the token is the captured group.
FINGERPRINTS = (
    ("greenhouse", r"boards\.greenhouse\.io/([a-zA-Z0-9_-]+)"), ("ashby", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)"), ("lever", r"jobs\.lever\.co/([a-zA-Z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([a-zA-Z0-9_-]+)"), ("teamtailor", r"([a-zA-Z0-9_-]+)\.teamtailor\.com"), ("bamboohr", r"([a-zA-Z0-9_-]+)\.bamboohr\.com"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"), ("recruitee", r"([a-zA-Z0-9_-]+)\.recruitee\.com"), ("pinpoint", r"([a-zA-Z0-9_-]+)\.pinpointhq\.com"),
    ("breezy", r"([a-zA-Z0-9_-]+)\.breezy\.hr"), ("jobvite", r"jobs\.jobvite\.com/([a-zA-Z0-9_-]+)"), ("workday", r"([a-zA-Z0-9_-]+)\.wd[0-9]+\.myworkdayjobs\.com"),
    ("icims", r"([a-zA-Z0-9_-]+)\.icims\.com"), ("successfactors", r"([a-zA-Z0-9_-]+)\.successfactors\.com"), ("taleo", r"([a-zA-Z0-9_-]+)\.taleo\.net"), ("avature", r"([a-zA-Z0-9_-]+)\.avature\.net"),
)
HEURISTIC_PROVIDERS = ("greenhouse", "lever", "ashby", "workable", "teamtailor")
#: Second write gate: providers, providers whose token is an address, and words that are no token.
WRITABLE_PROVIDERS = _terms("""
greenhouse, greenhouse_eu, lever, lever_eu, ashby, workable, recruitee, smartrecruiters, teamtailor, bamboohr, personio, jobvite, workday, oracle_cloud,
icims, successfactors, taleo, avature, pinpoint, breezy, custom""")
FULL_URL_PROVIDERS = ("workday", "oracle_cloud", "icims", "successfactors", "custom")
GENERIC_TOKENS = _terms("""
www, jobs, careers, apply, hire, work, en-us, en, job, career, about, company, portal, external, internal, search, listing, us, uk, eu, fr, de, v1, v2, api,
home, index, page, post, category, app, careersite, data, team, corp, ltd, group, solutions, services, global, international, tech, digital, media""")
#: Where a probe's body lists its postings.
PROBE_LISTS = {
    "greenhouse": "$.departments", "lever": "$", "ashby": "$.jobs", "workable": "$.results", "teamtailor": "$.data", "smartrecruiters": "$.content", "recruitee": "$.offers",
    "pinpoint": "$.posts", "breezy": "$.positions", "jobvite": "$.jobs",
}
#: Feeds that the verdict reads: where the postings are, and the fields of a posting's place.
VERDICT_FEEDS = {
    "greenhouse": ("$.jobs", ("$.location.name",)), "lever": ("$", ("$.categories.location",)), "ashby": ("$.jobPostings", ("$.locationName",)),
    "workable": ("$.results", ("$.location.city", "$.location.country")), "smartrecruiters": ("$.content", ("$.location.city", "$.location.country")),
    "recruitee": ("$.offers", ("$.location",)), "personio": ("$.data", ("$.office", "$.attributes.office")), "bamboohr": ("$.result", ("$.location",)),
}
#: Providers that the sheet importer knows, each by its own name.
IMPORT_PROVIDERS = _terms("""
ashby, greenhouse, lever, workable, teamtailor, bamboohr, smartrecruiters, pinpoint, breezy, breezyhr, personio, workday, workday_enterprise, oracle_cloud,
successfactors, icims, hibob, rippling, recruitee, eightfold, linkedin, custom""")
INVALID_TOKENS = _terms("""
www, jobs, careers, apply, hire, work, en-us, en, job, career, about, company, portal, external, internal, search, listing,
us, uk, eu, fr, de, v1, v2, api, home, index, page, post, category, assets, asset, article, articles, lib, libs, library,
web, locale, locales, i18n, public, static, images, img, css, js, javascript, styles, fonts, icons, media, files, documents,
connect, login, signin, auth, logout, help, support, faq, contact, feedback, product, products, updates, news, blog,
pricing, solutions, platform, features, viewer, pdfjs, pdf, document, cancel, rehire, onboarding, eor, restart""")
CAREERS_PATTERNS = ("careers", "jobs", "work.with.us", "join.us", "we.are.hiring", "join.our.team", "open.roles", "vacancies", "opportunities")
EXCLUDED_PATHS = ("/", "", "/about", "/contact", "/blog", "/news", "/pricing", "/product", "/solutions", "/platform", "/login", "/signup", "/docs", "/support")
PROVIDER_ALIASES = {
    "ashbyhq": "ashby", "pinpointhq": "pinpoint", "breezyhr": "breezy", "smart_recruiters": "smartrecruiters", "team_tailor": "teamtailor",
    "workday_enterprise": "workday", "ultipro": "ultipro_html",
}
CUSTOM_ROUTES = (
    (r"jpmc\.fa\.oraclecloud|jpmorgan|jpmorganchase", "jpmc"), (r"higher\.gs\.com|goldman.?sachs", "goldmansachs"), (r"amazon\.jobs", "amazon"),
    (r"google\.com/about/careers", "google"), (r"jobs\.apple\.com", "apple"), (r"metacareers\.com", "meta"), (r"jobs\.nhs\.uk|nhs", "nhs"),
    (r"publicisgroupe\.com", "publicis"), (r"linkedin\.com", "linkedin"),
)
DISCOVERY_HOSTS = _terms("greenhouse.io, lever.co, ashbyhq.com, workable.com, smartrecruiters.com, teamtailor.com, personio., pinpointhq.com, breezy.hr, recruitee.com, myworkdayjobs.com, jobvite.com")
DISCOVERY_PATH = "careers?|jobs?|vacanc|opportunit|apply|join|talent|work-with-us|open-roles"
#: provider -> pattern whose first group is the token in an endpoint address.
ENDPOINT_TOKENS = {
    "greenhouse": "/boards/([^/]+)", "lever": "/postings/([^/?]+)", "workable": "/accounts/([^/]+)", "smartrecruiters": r"smartrecruiters\.com/([^/]+)",
    "teamtailor": r"^https?://([^./]+)[^/]*teamtailor\.com", "pinpoint": r"^https?://([^./]+)[^/]*pinpointhq\.com", "bamboohr": r"^https?://([^./]+)[^/]*bamboohr\.com",
    "breezy": r"^https?://([^./]+)[^/]*breezy\.hr", "recruitee": r"^https?://([^./]+)[^/]*recruitee\.com",
}
