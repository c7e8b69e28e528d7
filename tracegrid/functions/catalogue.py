"""Names, patterns and numbers that results depend on, as plain text in their natural order."""

from __future__ import annotations

# Standard headers, which never tell platforms apart.
GENERIC_HEADERS = """date content-type content-length content-encoding transfer-encoding connection keep-alive accept-ranges etag last-modified expires pragma age via vary upgrade host referer
strict-transport-security x-content-type-options x-frame-options x-xss-protection referrer-policy content-security-policy x-content-security-policy x-webkit-csp feature-policy permissions-policy
cross-origin-embedder-policy cross-origin-opener-policy cross-origin-resource-policy
access-control-allow-origin access-control-allow-credentials access-control-allow-headers access-control-allow-methods access-control-max-age access-control-expose-headers
nel report-to server-timing cache-control surrogate-control cdn-cache-control alt-svc early-data http2-settings
content-disposition content-language content-location content-range accept accept-charset accept-encoding accept-language expect from if-match if-modified-since if-none-match if-range if-unmodified-since
max-forwards proxy-authorization range te user-agent authorization www-authenticate proxy-authenticate allow location retry-after warning
sec-websocket-accept sec-websocket-extensions sec-websocket-key sec-websocket-protocol sec-websocket-version
x-forwarded-for x-forwarded-proto x-forwarded-host x-real-ip x-original-url x-rewrite-url x-request-id x-correlation-id x-trace-id
x-b3-traceid x-b3-spanid x-b3-parentspanid x-b3-sampled x-b3-flags traceparent tracestate""".split()

# Headers whose value may name a platform.
INDICATIVE_HEADERS = "server x-powered-by powered-by x-generator generator x-cms x-framework x-platform x-application".split()

# Headers of caches, proxies and delivery networks.
INFRASTRUCTURE_HEADERS = """x-cache x-cache-status x-cache-hit x-cache-lookup x-cacheable x-varnish x-cdn x-edge-location x-served-by x-backend-server x-proxy-cache x-fastly-request-id
x-amz-cf-id x-amz-cf-pop x-amz-request-id cf-ray cf-cache-status cf-request-id x-azure-ref x-ms-request-id x-ms-routing-request-id""".split()

# Headers of one platform: header, platforms, conflicting platforms, specificity.
PLATFORM_HEADERS = [
    ("x-pingback", ["WordPress"], ["Shopify", "Drupal", "Joomla"], 0.95),
    ("x-wp-total", ["WordPress"], ["Shopify", "Drupal", "Joomla"], 0.98),
    ("x-wp-totalpages", ["WordPress"], ["Shopify", "Drupal", "Joomla"], 0.98),
    ("x-wp-nonce", ["WordPress"], ["Shopify", "Drupal", "Joomla"], 0.95),
    ("x-shopify-shop-id", ["Shopify"], ["WordPress", "Drupal", "Magento", "WooCommerce"], 0.99),
    ("x-shopify-stage", ["Shopify"], ["WordPress", "Drupal", "Magento"], 0.95),
    ("x-shopify-request-id", ["Shopify"], ["WordPress", "Drupal", "Magento"], 0.90),
    ("shopify-checkout-api-token", ["Shopify"], ["WordPress", "Drupal", "Magento", "WooCommerce"], 0.99),
    ("x-drupal-cache", ["Drupal"], ["WordPress", "Shopify", "Joomla"], 0.95),
    ("x-generator", ["Drupal", "Joomla", "WordPress"], [], 0.60),
    ("x-magento-tags", ["Magento"], ["Shopify", "WooCommerce", "WordPress"], 0.95),
    ("x-vercel-cache", ["Vercel", "Next.js"], ["Netlify", "AWS"], 0.90),
    ("x-nf-request-id", ["Netlify"], ["Vercel", "AWS"], 0.95),
    ("x-frame-options", [], [], 0.10),
    ("x-content-type-options", [], [], 0.10),
]

# Parts of header names that name a platform; the longest that fits counts, those that end in '-' fit as a prefix too.
NAME_PATTERNS = [
    ("wordpress", "WordPress"), ("wp-", "WordPress"), ("drupal", "Drupal"), ("joomla", "Joomla"), ("duda", "Duda"), ("d-", "Duda"), ("shopify", "Shopify"), ("x-shopid", "Shopify"),
    ("magento", "Magento"), ("woocommerce", "WooCommerce"), ("bigcommerce", "BigCommerce"), ("prestashop", "PrestaShop"), ("opencart", "OpenCart"), ("wix", "Wix"), ("squarespace", "Squarespace"),
    ("weebly", "Weebly"), ("godaddy", "GoDaddy"), ("jimdo", "Jimdo"), ("aem", "AEM"), ("sitecore", "Sitecore"), ("contentful", "Contentful"), ("liferay", "Liferay"), ("kentico", "Kentico"),
    ("nextjs", "Next.js"), ("next-", "Next.js"), ("nuxt", "Nuxt"), ("gatsby", "Gatsby"), ("vercel", "Vercel"), ("netlify", "Netlify"), ("cloudflare", "Cloudflare"), ("cf-", "Cloudflare"),
    ("x-amz-", "AWS"), ("fastly", "Fastly"), ("akamai", "Akamai"),
]

# Vendors: name, category, header names.
VENDORS = [
    ("Cloudflare", "cdn", "cf-ray cf-cache-status cf-request-id cf-visitor cf-connecting-ip cf-ipcountry cf-worker cf-edge-cache"),
    ("AWS CloudFront", "cdn", "x-amz-cf-id x-amz-cf-pop x-amzn-requestid x-amzn-trace-id x-amz-apigw-id"),
    ("Fastly", "cdn", "x-fastly-request-id x-served-by x-cache x-cache-hits x-timer fastly-debug-digest"),
    ("Akamai", "cdn", "x-akamai-edgescape x-akamai-request-id akamai-origin-hop x-akamai-transformed"),
    ("WordPress", "cms", "x-wp-total x-wp-totalpages x-pingback x-wp-nonce x-robots-tag"),
    ("Shopify", "ecommerce", "x-shopify-shop-id x-shopify-stage x-shopify-request-id shopify-checkout-api-token x-sorting-hat-podid x-sorting-hat-shopid"),
    ("Drupal", "cms", "x-drupal-cache x-drupal-dynamic-cache x-generator"),
    ("Duda", "cms", "d-geo d-cache d-sid d-rid d-cache-status"),
    ("Google Analytics", "analytics", "x-google-analytics-id x-ga-measurement-id x-gtm-server-preview"),
    ("Laravel", "framework", "x-laravel-session laravel_session"),
    ("ASP.NET", "framework", "x-aspnetmvc-version x-aspnet-version x-powered-by"),
    ("reCAPTCHA", "security", "x-recaptcha-action recaptcha-token"),
]

# Technology signatures: name, required headers, headers that exclude it.
SIGNATURES = [
    ("Shopify Platform", ["x-shopify-shop-id", "x-sorting-hat-shopid"], ["x-wp-total", "x-drupal-cache"]),
    ("WordPress + Cloudflare", ["x-wp-total", "cf-ray"], ["x-shopify-shop-id", "x-drupal-cache"]),
    ("Duda Platform", ["d-geo", "d-cache"], ["x-wp-total", "x-shopify-shop-id"]),
    ("Drupal + Varnish", ["x-drupal-cache", "via"], ["x-wp-total", "x-shopify-shop-id"]),
    ("Nginx + FastCGI", ["server", "x-powered-by"], []),
]
VENDOR_SIGNATURES = [
    ("WordPress + Cloudflare", ["x-pingback", "cf-ray"], ["x-drupal-cache", "x-shopify-shop-id"]),
    ("Shopify + Fastly", ["x-shopify-shop-id", "x-served-by"], ["x-wp-total", "x-drupal-cache"]),
    ("Drupal + CloudFront", ["x-drupal-cache", "x-amz-cf-id"], ["x-wp-total", "cf-ray"]),
    ("Laravel + Cloudflare", ["x-laravel-session", "cf-ray"], ["x-aspnet-version"]),
    ("Duda", ["d-geo", "d-cache"], ["x-wp-total", "x-shopify-shop-id"]),
]

# Phrases of refused and missing pages.
BOT_PHRASES = ["cloudflare", "security check", "access denied", "bot detection", "ddos protection", "please enable javascript", "browser check", "verify you are human"]
ERROR_PHRASES = ["page not found", "error 404", "404 not found", "page cannot be found", "the requested page could not be found"]

# Walls against automated visits: name, provider, kind, confidence, rank of difficulty (1 to 4), indicators.
WALLS = [
    ("Cloudflare Challenge", "Cloudflare", "behavior_analysis", 0.95, 3, ["cf-ray", "cloudflare", "just a moment", "checking your browser"]),
    ("Cloudflare Bot Management", "Cloudflare", "fingerprinting", 0.9, 4, ["cf-bot-management", "challenge-platform.com"]),
    ("PerimeterX Protection", "PerimeterX", "behavior_analysis", 0.95, 4, ["perimeterx", "_pxappid", "px-captcha", "blocked because we believe you are using automation"]),
    ("DataDome Protection", "DataDome", "behavior_analysis", 0.9, 3, ["datadome", "dd-captcha", "robot or automated system"]),
    ("Imperva Incapsula", "Imperva", "rate_limiting", 0.85, 2, ["incap_ses", "incapsula", "visid_incap"]),
    ("Akamai Bot Manager", "Akamai", "fingerprinting", 0.9, 4, ["akamai", "_abck", "akam-sw"]),
    ("Google reCAPTCHA", "Google", "captcha", 0.95, 3, ["recaptcha", "g-recaptcha", "grecaptcha"]),
    ("hCaptcha", "hCaptcha", "captcha", 0.95, 3, ["hcaptcha", "h-captcha"]),
    ("Sucuri Firewall", "Sucuri", "rate_limiting", 0.8, 2, ["sucuri", "x-sucuri"]),
    ("Rate Limiting", "Generic", "rate_limiting", 0.7, 1, ["too many requests", "rate limit", "slow down"]),
    ("IP Blocking", "Generic", "ip_blocking", 0.8, 2, ["ip blocked", "access denied", "forbidden", "your ip has been banned"]),
    ("User Agent Blocking", "Generic", "fingerprinting", 0.6, 1, ["user agent blocked", "automated request", "bot detected"]),
]

# Shapes of header names.
NAME_SHAPES = [
    ("x-word-word", r"^x-[a-z]+-[a-z]+$"), ("word-word-word", r"^[a-z]+-[a-z]+-[a-z]+$"), ("word_word", r"^[a-z]+_[a-z]+$"), ("word-id", r"^[a-z]+-id$"), ("x-word-id", r"^x-[a-z]+-id$"),
    ("word-version", r"^[a-z]+-version$"), ("word-time", r"^[a-z]+-time$"), ("word-cache", r"^[a-z]+-cache$"), ("word-token", r"^[a-z]+-token$"), ("cf-word", r"^cf-[a-z]+$"), ("word-status", r"^[a-z]+-status$"),
]

# robots.txt paths by platform: path, confidence. The first list is the scorer's, in the order in which ties are decided.
ROBOTS_PATHS = {
    "Drupal": [("/core/", 0.9), ("/profiles/", 0.8), ("/sites/", 0.7), ("/modules/", 0.6), ("/themes/", 0.5), ("/misc/", 0.4)],
    "WordPress": [("/wp-admin/", 0.9), ("/wp-content/", 0.9), ("/wp-includes/", 0.8), ("/wp-json/", 0.7), ("wp-login.php", 0.6), ("wp-admin/admin-ajax.php", 0.8), ("/feed/", 0.4), ("sitemap_index.xml", 0.3)],
    "Joomla": [("/administrator/", 0.9), ("/components/", 0.8), ("/modules/", 0.7), ("/templates/", 0.6), ("/media/", 0.5), ("/cache/", 0.4)],
}
SHARED_PATHS = ["/modules/", "/themes/", "/media/", "/cache/"]

# Signatures of page text by platform, and the weight of each way to look.
HTML_SIGNATURES = {
    "WordPress": ["/wp-content/", "/wp-includes/", "/wp-json/", "/wp-admin/", "wp-config.php", "wp-login.php", "wp-cron.php"],
    "Joomla": ['content="Joomla!', "joomla", "/administrator/", "/components/", "/modules/", "/templates/", "Joomla.JText", "joomla-cms", "joomla-script-options new", "/media/jui/js/"],
    "Drupal": ["/sites/all/", "/misc/drupal.js", "drupal-settings-json", "Drupal.settings", "drupal", "/core/", "/modules/", "/themes/"],
    "Duda": ["irp.cdn-website.com", "lirp.cdn-website.com", "dudamobile.com", "duda_website_builder", "_duda_", "dmalbum", "dmrespimg"],
}
METHOD_WEIGHTS = {
    "WordPress": {"meta-tag": 1.0, "http-headers": 0.9, "robots-txt": 0.85, "html-content": 0.8},
    "Joomla": {"meta-tag": 1.0, "http-headers": 0.95, "robots-txt": 0.9, "html-content": 0.8},
    "Drupal": {"http-headers": 1.0, "meta-tag": 1.0, "robots-txt": 0.85, "html-content": 0.8},
    "Duda": {"meta-tag": 1.0, "duda-javascript": 1.0, "html-content": 0.8, "http-headers": 0.7},
}
EXCLUSIVE_PLATFORMS = [("WordPress", "Drupal"), ("WordPress", "Joomla"), ("Shopify", "Magento"), ("Drupal", "Joomla")]

# Optional headers of the vendor signatures, in their order.
VENDOR_OPTIONAL = [["x-wp-total", "cf-cache-status"], ["x-shopify-stage", "x-cache"], ["x-generator", "x-amz-cf-pop"], ["laravel_session", "cf-cache-status"], ["d-sid", "d-rid", "d-cache-status"]]

# Categories of header names that fit a vendor's category.
FITTING_CATEGORIES = {
    "cdn": ["infrastructure", "caching", "performance"], "cms": ["infrastructure", "content-management"], "ecommerce": ["infrastructure", "commerce", "payment"], "analytics": ["tracking", "monitoring"],
    "security": ["infrastructure", "security"], "framework": ["infrastructure", "development"], "hosting": ["infrastructure", "hosting"],
}

# Meta tags of any site, tracking scripts and common libraries, which filters for telling features leave out.
UNIVERSAL_METAS = """viewport robots description charset author keywords content-type theme-color msapplication-tilecolor msapplication-config apple-mobile-web-app-capable apple-mobile-web-app-status-bar-style apple-mobile-web-app-title
application-name msvalidate.01 google-site-verification yandex-verification p:domain_verify facebook-domain-verification twitter:card twitter:site twitter:creator og:type og:title og:description og:image og:url og:site_name og:locale""".split()
TRACKING_SCRIPTS = """jquery bootstrap google-analytics gtag facebook-pixel facebook.net fbevents google-tag-manager googletagmanager googlesyndication doubleclick google-adservices googleadservices hotjar mixpanel segment intercom zendesk freshchat tawk crisp
typekit fonts.googleapis cdnjs.cloudflare jsdelivr unpkg polyfill modernizr respond html5shiv""".split()
COMMON_LIBRARIES = """lodash underscore moment axios fetch socket.io swiper owl.carousel slick fancybox lightbox photoswipe aos wow animate isotope masonry parallax scrollmagic waypoints sticky lazyload intersection-observer""".split()

# Parts of script addresses by platform: part, category, platform.
SCRIPT_PARTS = [
    ("wp-admin", "cms", "WordPress"), ("wp-content/plugins", "cms", "WordPress"), ("wp-content/themes", "cms", "WordPress"), ("wp-includes", "cms", "WordPress"), ("woocommerce", "ecommerce", "WooCommerce"),
    ("drupal", "cms", "Drupal"), ("modules/contrib", "cms", "Drupal"), ("modules/custom", "cms", "Drupal"), ("themes/contrib", "cms", "Drupal"), ("sites/default/files", "cms", "Drupal"),
    ("joomla", "cms", "Joomla"), ("administrator", "cms", "Joomla"), ("components/com_", "cms", "Joomla"), ("modules/mod_", "cms", "Joomla"), ("templates/", "cms", "Joomla"),
    ("ghost", "cms", "Ghost"), ("content/themes", "cms", "Ghost"), ("assets/built", "cms", "Ghost"),
    ("shopify", "ecommerce", "Shopify"), ("shopifycloud", "ecommerce", "Shopify"), ("checkout.shopify", "ecommerce", "Shopify"), ("shopify-analytics", "ecommerce", "Shopify"),
    ("magento", "ecommerce", "Magento"), ("pub/static", "ecommerce", "Magento"), ("adminhtml", "ecommerce", "Magento"), ("mage/", "ecommerce", "Magento"),
    ("wix.com", "builder", "Wix"), ("wixstatic", "builder", "Wix"), ("parastorage", "builder", "Wix"), ("squarespace", "builder", "Squarespace"), ("sqspcdn", "builder", "Squarespace"), ("squarespace-analytics", "builder", "Squarespace"),
    ("webflow", "builder", "Webflow"), ("uploads-ssl.webflow", "builder", "Webflow"),
    ("react.development", "framework", "React"), ("react.production", "framework", "React"), ("react-dom", "framework", "React"), ("_next/static", "framework", "Next.js"), ("next/router", "framework", "Next.js"),
    ("vue.js", "framework", "Vue.js"), ("vuex", "framework", "Vue.js"), ("nuxt", "framework", "Nuxt.js"), ("angular", "framework", "Angular"), ("@angular", "framework", "Angular"), ("ng-", "framework", "Angular"),
    ("google-analytics", "analytics", "Google Analytics"), ("googletagmanager", "analytics", "Google Tag Manager"), ("gtag", "analytics", "Google Analytics 4"), ("omniture", "analytics", "Adobe Analytics"), ("adobe-analytics", "analytics", "Adobe Analytics"),
    ("django", "backend", "Django"), ("admin/js", "backend", "Django"), ("rails", "backend", "Ruby on Rails"), ("turbo", "backend", "Ruby on Rails"), ("stimulus", "backend", "Ruby on Rails"),
    ("jquery", "library", "jQuery"), ("jquery-ui", "library", "jQuery UI"), ("bootstrap", "library", "Bootstrap"),
]
SURE_SCRIPT_PARTS = ["wp-admin", "wp-content", "shopify", "drupal", "wix", "squarespace"]
SCRIPT_CATEGORY_CONFIDENCE = {"cms": 0.85, "ecommerce": 0.9, "builder": 0.95, "framework": 0.8, "backend": 0.7, "analytics": 0.85, "hosting": 0.6, "library": 0.7}

# Selectors counted on a page: name, and the pattern of an opening tag that it selects.
SELECTORS = [
    ('script[src*="wp-"]', r"<script\b[^>]*\bsrc\s*=\s*[\"'][^\"']*wp-"), ('link[href*="wp-"]', r"<link\b[^>]*\bhref\s*=\s*[\"'][^\"']*wp-"), ('script[src*="drupal"]', r"<script\b[^>]*\bsrc\s*=\s*[\"'][^\"']*drupal"),
    ('script[src*="joomla"]', r"<script\b[^>]*\bsrc\s*=\s*[\"'][^\"']*joomla"), ('div[id*="wp-"]', r"<div\b[^>]*\bid\s*=\s*[\"'][^\"']*wp-"), ('div[class*="wp-"]', r"<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*wp-"),
    ('body[class*="wp-"]', r"<body\b[^>]*\bclass\s*=\s*[\"'][^\"']*wp-"), ('html[class*="wp-"]', r"<html\b[^>]*\bclass\s*=\s*[\"'][^\"']*wp-"), ('link[href*="/sites/"]', r"<link\b[^>]*\bhref\s*=\s*[\"'][^\"']*/sites/"),
    ('script[src*="/sites/"]', r"<script\b[^>]*\bsrc\s*=\s*[\"'][^\"']*/sites/"), ('div[id*="block-"]', r"<div\b[^>]*\bid\s*=\s*[\"'][^\"']*block-"), ('div[class*="block-"]', r"<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*block-"),
]

# Columns of a flat export, in their order.
EXPORT_COLUMNS = "url timestamp finalUrl statusCode cms confidence version redirectCount protocolUpgraded loadTime htmlSize metaTagCount scriptCount linkCount".split()

# Script marks of one platform: mark, confidence.
DUDA_SCRIPT_MARKS = [
    ("window.parameters = window.parameters", 0.99), ("sitetype: atob('rfvequ9orq==')", 0.99), ("productid: 'dm_direct'", 0.98), ("blockcontainerselector: '.dmbody'", 0.98), ("systemid: 'us_direct_production'", 0.90), ('var d_version = "production_', 0.99),
    ("irp.cdn-website.com", 0.85), ("lirp.cdn-website.com", 0.85), ("dudamobile.com", 0.80), ("dmalbum", 0.75), ("dmrespimg", 0.75), ("duda_website_builder", 0.70), ("_duda_", 0.70),
]
