"""Labelled texts to fit the residue models on: written out, or made from short rules. Fixed values throughout.

They are what content systems, page builders, web servers, browsers and frameworks are known to put out, in
six languages. Natural prose has no list here: its model is counted over the whole corpus.
"""

from __future__ import annotations

import itertools

# Names of fields that templates leave unfilled.
FIELD_NAMES = (
    "name user username first_name firstname last_name lastname full_name customer customer_name client buyer recipient sender guest member reviewer author email phone address street city country state zip postcode date month year time purchase_date order_date delivery_date "
    "order order_id order_number invoice tracking_number account id item item_name item_title product product_name product_title sku variant brand model category price amount total currency discount quantity days duration size weight rating stars score store shop shop_name company seller team site url link "
    "title subject body review review_body review_title comment message text content caption description image value variable field user.name item.title item.name order.id order.total placeholder "
    "vorname nachname kundenname kunde produktname produkt artikel bestellnummer marke preis stadt datum laden händler firma anrede betrag "
    "prenom prénom nom client nom_produit produit marque prix ville magasin commande montant adresse "
    "nombre apellido cliente nombre_producto producto marca precio ciudad tienda pedido fecha importe empresa "
    "имя фамилия клиент покупатель товар название цена город магазин заказ бренд дата сумма компания "
    "お客様名 顧客名 商品名 店舗 店舗名 価格 注文番号 ブランド 都市 日付 氏名 会社名 住所 金額"
).split()
MARKS = (
    ("{{", "}}"), ("{{ ", " }}"), ("{{{", "}}}"), ("{", "}"), ("${", "}"), ("{$", "}"), ("#{", "}"), ("@{", "}"), ("{% ", " %}"), ("<%= ", " %>"), ("<% ", " %>"), ("[[", "]]"), ("[", "]"), ("[%", "%]"), ("%", "%"), ("%%", "%%"), ("%(", ")s"),
    ("%{", "}"), ("@@", "@@"), ("##", "##"), ("!!", "!!"), ("^^", "^^"), ("||", "||"), ("~", "~"), ("$", "$"), ("$", ""), ("*|", "|*"), ("__", "__"), ("<", ">"), ("&lt;", "&gt;"), ("<!--", "-->"), ("{{", ":"), ("{{", " "), ("«", "»"), ("【", "】"), ("<<", ">>"), (":", ":"),
)
# Written-out prompts around a field's name, by language: forms, and names as they stand there.
PROMPTS = (
    ("(your {} here)|[your {} here]|[your {}]|<your {}>|[insert {}]|[insert {} here]|insert {} here|({} goes here)|[enter {}]|enter {} here|[add {}]|<insert {}>|todo: add {}|[missing {}]|({} to be added)", "name|product|product name|first name|date|company|title|link|text|pros|cons"),
    ("(ihr {} hier)|[{} einfügen]|[{} hier einfügen]|hier {} eintragen|({} ergänzen)|[{} eintragen]|<{} einsetzen>|[ihr {}]", "name|namen|vorname|produkt|produktname|datum|firma|preis|text|vorteile|nachteile"),
    ("(votre {} ici)|[insérer {}]|[insérer le {}]|[insérer votre {}]|<votre {}>|[votre {}]|(indiquez votre {})|[{} à compléter]", "nom|prénom|produit|nom du produit|date|ville|prix|texte|avantages"),
    ("(su {} aquí)|(escriba aquí su {})|[inserte el {}]|[insertar {}]|[su {}]|<su {}>|[{} aquí]|({} por completar)", "nombre|apellido|producto|precio|fecha|texto|empresa|ventajas"),
    ("(ваше {} здесь)|[вставьте {}]|[введите {}]|(укажите {})|[ваше {}]|<{}>|[{} здесь]", "имя|название товара|дату|цену|город|название|текст|достоинства"),
    ("（ここに{}を入力）|【{}を入力】|（{}を記入）|【{}】|（お{}）|［{}］|（ここに{}）", "名前|お名前|商品名|氏名|日付|店舗名|本文|良い点"),
)
PLACEHOLDERS = (
    "[placeholder]", "<placeholder>", "[xx]", "[xx] stars", "xx stars", "[todo]", "todo: add text", "todo: fill in", "todo: write", "todo: check", "todo: describe", "todo: replace", "todo: update", "todo - ", "fixme", "tbd", "[tbd]", "[tbc]", "[object object]", "undefined undefined", "undefined", "null null", "nan", "#n/a", "#ref!", "#value!", "#name?", "#null!", "#div/0!", "[missing translation: item.title]", "missing translation: item.title",
    "translation missing: en.item.title", "missing_key.title", "label_not_set", "value_not_set", "not_set", "dear %s, thank you", "hello %s, welcome", "%s", "%d", "%1$s", "%2$s", "order %1$s of %2$s", "hello {0}, your", "dear {1},", "{0} of {1}", "___________", "________", "name: ________", "date: ________", "[...]", "[…]", "xxxx", "xxxxxx",
    "<à compléter>", "[à compléter]", "à compléter", "<por completar>", "[por completar]", "<заполнить>", "[заполнить]", "<auszufüllen>", "[auszufüllen]", "（未入力）", "〇〇〇〇", "〇〇様", "○○様", "○○○", "〇〇さん", "○○さん", "〇〇を", "〇〇の", "○○の", "〇〇〇",
)
# What failed filling leaves between any words.
BARE = ("%s", "%d", "%1$s", "{0}", "#n/a", "#ref!")
# The words of the usual generators of nonsense Latin, and the passages that they come from.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum "
    "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo "
    "nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit "
    "at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident similique sunt in culpa "
    "et harum quidem rerum facilis est et expedita distinctio nam libero tempore cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus omnis voluptas assumenda est omnis dolor repellendus "
    "temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae itaque earum rerum hic tenetur a sapiente delectus ut aut reiciendis voluptatibus maiores alias "
    "pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget tempor sit amet ante donec eu libero sit amet quam egestas semper aenean ultricies mi vitae est "
    "mauris placerat eleifend leo quisque sit amet est et sapien ullamcorper pharetra vestibulum erat wisi condimentum sed commodo vitae ornare sit amet wisi aenean fermentum elit eget tincidunt condimentum eros ipsum rutrum orci sagittis tempus lacus "
    "accumsan aliquam aliquet aptent arcu auctor augue bibendum blandit class congue conubia convallis cras cubilia curabitur cursus dapibus diam dictum dictumst dis efficitur elementum etiam euismod facilisi faucibus felis finibus fringilla fusce gravida "
    "habitasse hac hendrerit himenaeos iaculis imperdiet inceptos integer interdum justo lacinia laoreet lectus ligula litora lobortis luctus maecenas magnis massa mattis maximus metus molestie montes mus nascetur natoque nec nibh nisl nostra nullam nunc "
    "parturient penatibus per phasellus platea porta porttitor posuere potenti praesent pretium primis proin pulvinar purus rhoncus ridiculus risus scelerisque sem sociosqu sodales sollicitudin suscipit suspendisse taciti tellus torquent ultrices urna varius vehicula vel venenatis vivamus viverra volutpat vulputate"
)
FILLER = (
    "test", "testing", "dummy", "placeholder", "lorem ipsum", "this is a test", "this is only a test", "test test test", "testing testing one two three", "testing 1 2 3", "test review please ignore", "just a test, please delete", "please ignore this", "ignore this post", "test entry", "test post", "sample content", "sample text sample text", "body text goes here", "text goes here", "your text here", "add your text here",
    "click here to edit this text", "double click to edit", "edit this text", "write your review here", "type your text here", "enter your text here", "your content goes here", "description goes here", "headline goes here", "placeholder text", "placeholder comment", "filler text filler text", "dummy text dummy text", "dummy content", "dummy text of the printing and typesetting industry",
    "this is placeholder text", "this text is a placeholder", "this text will be replaced", "to be replaced with real content", "replace this text with your own", "this is sample text", "this is some sample content to show the layout", "text for layout purposes only", "demo data do not use", "example data do not use", "for internal testing only", "not for publication", "created by an automated test", "automatically generated test data",
    "content coming soon", "coming soon", "more text to follow", "blah blah blah blah blah", "bla bla bla bla", "foo bar baz qux", "foo bar foo bar", "hello world", "hello world! this is your first post", "the quick brown fox jumps over the lazy dog", "xxx xxx xxx", "abc abc abc", "abcd efgh ijkl", "abcdefghijklmnopqrstuvwxyz", "aaa bbb ccc", "aaa aaa aaa", "1234567890 1234567890", "abc123 abc123",
    "dies ist ein blindtext", "blindtext blindtext blindtext", "weit hinten, hinter den wortbergen", "mustertext mustertext mustertext", "hier steht später der text", "hier könnte ihr text stehen", "hier steht ein platzhaltertext", "platzhaltertext", "beispieltext beispieltext", "dies ist nur ein test", "das ist ein test", "testeintrag bitte löschen", "testbeitrag", "probetext", "nur zum testen", "dieser text wird noch ersetzt", "text folgt",
    "ceci est un test", "ceci est un texte de remplissage", "texte de remplissage", "texte d'exemple", "texte factice texte factice", "faux texte", "votre texte ici", "texte à remplacer", "ceci est un texte d'exemple", "essai essai essai", "test à supprimer", "contenu à venir", "merci d'ignorer ce message",
    "esto es una prueba", "prueba prueba prueba", "texto de prueba", "texto de ejemplo", "texto de relleno texto de relleno", "este texto es de relleno", "su texto aquí", "escriba aquí su texto", "texto que se sustituirá", "ejemplo de texto", "contenido de prueba", "contenido próximamente", "ignore este mensaje", "no publicar",
    "это тест", "это просто тест", "тест тест тест", "проверка проверка проверка", "текст-заполнитель", "пример текста", "здесь будет текст", "здесь будет ваш текст", "тестовая запись", "тестовое сообщение", "тестовый отзыв, не публиковать", "рыба текст рыба текст", "рыбный текст", "заглушка текста", "скоро здесь появится текст", "не публиковать",
    "テスト テスト テスト", "テストテストテスト", "これはテストです。", "テスト投稿です。", "これはダミーテキストです。", "ダミーテキスト ダミーテキスト", "ダミー文章", "サンプルテキスト", "サンプル文章です。", "ここに本文が入ります。", "ここにテキストが入ります。", "ここに文章を入力してください。", "あああああ", "あいうえお あいうえお", "準備中です。", "公開しないでください。",
)
# Rows and columns of keyboards, which aimless typing runs along.
KEYS = "qwertyuiop asdfghjkl zxcvbnm qwertzuiop yxcvbnm azertyuiop qsdfghjklm wxcvbn йцукенгшщзхъ фывапролджэ ячсмитьбю qazwsxedc 1qaz2wsx3edc".split()
# Words that name a text as a stand-in, what it stands for, and sentences around them.
STAND_INS = "test sample example dummy draft demo mock placeholder filler temporary fake default".split()
STOOD_FOR = "text content review paragraph entry data body title comment message sentence post description".split()
STAND_IN_FORMS = (
    "{a} {n}", "{a} {n} {a} {n}", "{a} {a} {a}", "{n} of {a} {n}.", "[{a} {n}]", "({a} {n})", "[{a} {n}, 12 words]", "** {a} {n} **", "*** {a} {n} - do not publish ***", "{a}{n} do not publish", "{a} {n}. second {a} {n}. third {a} {n}.", "this is {a} {n}.", "this is {a} {n} and will be replaced.", "this {a} {n} will be removed.",
    "here is {a} {n}.", "{a} {n} goes here.", "{a} {n} 12", "{a} {n} 12: 3456", "your {a} {n} here", "delete this {a} {n}", "please ignore this {a} {n}", "{a} {n} generated by the system.", "{a} {n} for the layout.",
)
SCRIPT_WORDS = ("javascript", "java script", "js", "scripts", "scripting", "active scripting", "client-side scripts", "cookies", "javascript and cookies")
SCRIPT_NOTICES = (
    "please enable {} to view this page.", "please enable {} in your browser.", "please enable {} in your browser to continue.", "please enable {} to view the comments.", "please turn on {} in your browser and refresh the page to view its content.", "{} is required.", "{} is required to view this content.", "{} is required to use this site.", "{} is disabled.",
    "{} is disabled in your browser.", "{} is currently disabled in this browser. reactivate it to view this content.", "{} seems to be disabled in your browser. for the best experience on our site, be sure to turn on {} in your browser.", "{} must be enabled.", "{} must be enabled for the correct page display.", "enable {} to continue.", "you need to enable {} to run this app.",
    "you must enable {} to use this site.", "we're sorry but this app doesn't work properly without {} enabled. please enable it to continue.", "your browser does not support {}!", "your browser has {} turned off.", "{} is blocked by your settings.", "this page requires {}.", "this page needs {} to load.", "this site requires {} to function properly.", "this site works best with {} enabled.",
    "this feature requires {}. please check your settings and reload the page.", "it looks like {} is turned off in your browser.", "it looks like you have {} disabled.", "looks like {} is disabled; nothing can be shown without it.", "to view this page, allow {} and refresh.", "to use this website, switch on {} in your browser settings.", "turn off your ad blocker and allow {}, then reload this page.",
    "loading, please wait. if nothing happens, enable {}.", "<noscript>you need {}</noscript>", "<noscript>please enable {}.</noscript>", "content hidden: {} disabled", "bitte aktivieren sie {}.", "bitte aktivieren sie {} in ihrem browser, um fortzufahren.", "für diese seite wird {} benötigt.", "diese seite benötigt {}.", "{} ist in ihrem browser deaktiviert.", "{} sind in ihrem browser abgeschaltet.",
    "veuillez activer {} pour continuer.", "veuillez activer {} dans votre navigateur.", "cette page nécessite {}.", "ce site a besoin de {} pour fonctionner.", "{} est désactivé dans votre navigateur.", "{} sont désactivés dans votre navigateur.", "active {} para continuar.", "habilite {} en su navegador.", "esta página necesita {} para funcionar.", "este sitio requiere {}.",
    "{} está desactivado en su navegador.", "{} están desactivados en su navegador.", "включите {}, чтобы продолжить.", "пожалуйста, включите {} в вашем браузере.", "для работы страницы нужен {}.", "для просмотра этой страницы требуется {}.", "{} отключен в вашем браузере.", "{} отключены в вашем браузере.", "このページは{}が必要です。", "{}を有効にしてください。", "このサイトを表示するには{}を有効にしてください。",
    "お使いのブラウザでは{}が無効になっています。", "{}がオフになっています。",
)
# How languages other than English name scripts.
SCRIPT_NAMES = {"de": ("javascript", "skripte", "scripts", "cookies"), "fr": ("javascript", "les scripts", "les cookies"), "es": ("javascript", "los scripts", "las cookies"), "ru": ("javascript", "скрипты", "сценарии", "куки"), "ja": ("javascript", "スクリプト", "クッキー")}
HTTP = (
    "400 bad request", "401 unauthorized", "402 payment required", "403 forbidden", "404 not found", "404 page not found", "405 method not allowed", "406 not acceptable", "407 proxy authentication required", "408 request timeout", "409 conflict", "410 gone", "411 length required", "412 precondition failed", "413 payload too large", "413 request entity too large", "414 uri too long",
    "415 unsupported media type", "416 range not satisfiable", "417 expectation failed", "418 i'm a teapot", "421 misdirected request", "422 unprocessable entity", "423 locked", "424 failed dependency", "425 too early", "426 upgrade required", "428 precondition required", "429 too many requests", "431 request header fields too large", "451 unavailable for legal reasons",
    "500 internal server error", "501 not implemented", "502 bad gateway", "503 service unavailable", "504 gateway timeout", "505 http version not supported", "506 variant also negotiates", "507 insufficient storage", "508 loop detected", "510 not extended", "511 network authentication required", "520 unknown error", "521 web server is down", "522 connection timed out", "523 origin is unreachable", "524 a timeout occurred", "525 ssl handshake failed", "526 invalid ssl certificate",
)
HTTP_FORMS = ("{}", "http/1.1 {}", "http {c}: {t}", "http error {c}", "http error {}", "error {}", "error {c}: {t}", "{c} | {t}", "{c} - {t}", "status: {c}", "code: {c} {t}", "sorry - {c}", "{t} ({c})", "http {c} - {t}", "<h1>{t}</h1>", "<html><head><title>{c}</title></head><body><h1>{t}</h1></body></html>", "err_{u}", "{t}")
NOTICES = (
    # addresses and pages
    "the requested url was not found on this server.", "you may have typed the address wrongly or the page may have moved.", "please check the address and try again.", "oops! we can't find that page. go back to the home page or use the search.", "oops! that page can't be found.", "the page you requested could not be found.", "the page you are looking for might have been removed, had its name changed, or is temporarily unavailable.", "this page does not exist.", "this page isn't available. the link may be broken.", "nothing was found at this location.",
    "this content is no longer available.", "this post has been removed.", "blocked for legal reasons.", "unavailable due to legal reasons.", "this video is unavailable.", "redirecting... if you are not redirected automatically, click here.", "this article is not available in your country.", "this page isn't working. if the problem continues, contact the site owner.",
    # access
    "access denied. you don't have permission to access this resource.", "you are not authorized to view this page.", "you do not have permission to view this directory or page.", "access to this resource on the server is denied.", "access denied. reference #", "your access to this site has been limited by the site owner.", "your ip address has been blocked.", "you have been blocked.", "sorry, you have been blocked. you are unable to access this site.", "your request has been blocked.", "our systems have detected unusual traffic from your computer network.",
    "too many requests. please try again later.", "you are sending requests too quickly. please slow down.", "rate limit exceeded. retry after seconds", "please confirm that you are not a robot.", "please verify you are human", "verify you are human by completing the action below.", "complete the captcha to continue", "complete the security check to access this site.", "checking your browser before accessing the site.", "checking if the site connection is secure", "just a moment...", "please stand by, while we are checking your browser...", "select all images with traffic lights.", "i'm not a robot recaptcha privacy - terms",
    "your session has expired. please log in again.", "your session timed out.", "please log in to view this content.", "you must be logged in to view this page.", "sign in to continue", "log in or sign up to see more", "subscribe to continue reading.", "this content is for members only.", "please accept cookies to continue.", "we value your privacy. accept all cookies. manage preferences", "invalid token. please refresh the page and try again.",
    # servers
    "the server encountered an internal error and was unable to complete your request.", "the server could not complete your request.", "the server is temporarily unable to service your request due to maintenance downtime or capacity problems. please try again later.", "the server returned an invalid or incomplete response.", "the proxy server received an invalid response from an upstream server.", "upstream connect error or disconnect/reset before headers", "no healthy upstream", "upstream request timeout",
    "the request timed out.", "the connection has timed out. the server is taking too long to respond.", "the gateway did not receive a timely response from the upstream server.", "something went wrong. please try again later.", "something went wrong on our end.", "something went wrong. reload the page", "oops, something went wrong.", "an error occurred while processing your request.", "an unexpected error has occurred. please contact the administrator.", "an internal error has occurred. error id:", "if this problem persists, contact support and quote the reference", "application error: a client-side exception has occurred",
    "an error has occurred. reference number:", "request id:", "ray id:", "incident id:", "trace id:", "apache/2.4 server at port 80", "nginx/1.18.0", "nginx/1.24 (ubuntu)", "microsoft-iis/10.0", "openresty", "cloudflare ray id", "varnish cache server", "guru meditation", "cloudfront generated by cloudfront (cloudfront) request id",
    # maintenance
    "down for maintenance", "we are down for maintenance. please check back soon.", "the site is closed for maintenance. we'll be back at", "site under maintenance", "this site is under construction.", "scheduled maintenance in progress", "briefly unavailable for scheduled maintenance. check back in a minute.", "we'll be back soon", "we are working on it. please come back later.", "service temporarily unavailable", "the service is currently unavailable.", "we are experiencing high traffic. please wait.", "you are now in line. your estimated wait time is",
    # programs
    "could not connect to server", "could not connect to the database.", "error establishing a database connection", "database error: connection refused", "sqlstate[hy000] [2002] connection refused", "you have an error in your sql syntax; check the manual that corresponds to your server version", "ora-12541: tns:no listener", "mysql server has gone away", "{\"error\":{\"code\":500,\"message\":\"internal error\"}}", "{\"status\":\"error\",\"message\":\"not found\"}", "{\"error\":\"unauthorized\"}", "{\"message\":\"forbidden\"}", "<error><code>accessdenied</code><message>access denied</message></error>",
    "traceback (most recent call last): file \"/usr/lib/python3/app.py\", line 12, in <module>", "keyerror: 'name'", "typeerror: 'nonetype' object is not subscriptable", "java.lang.nullpointerexception at org.example.app.main(main.java:12)", "exception in thread \"main\" java.lang.outofmemoryerror", "at java.base/java.lang.thread.run(thread.java:833)", "caused by: java.net.connectexception: connection refused", "warning: undefined variable in /var/www/html/index.php on line 12", "warning: undefined array key in /var/www/html/page.php on line 12", "notice: undefined index in /home/site/public_html/index.php on line 12", "fatal error: uncaught exception",
    "fatal error: allowed memory size of bytes exhausted", "parse error: syntax error, unexpected", "uncaught typeerror: cannot read properties of undefined (reading 'length')", "uncaught referenceerror: $ is not defined", "unhandled exception", "server error in '/' application. runtime error", "segmentation fault (core dumped)", "stack overflow", "template error: variable is not defined", "liquid error: internal", "failed to load resource", "failed to fetch", "loading failed", "unable to load content", "unable to load comments", "loading...", "please wait...",
    # browsers
    "this site can't be reached", "this page can't be found", "unable to connect", "your connection is not private", "too many redirects", "the page isn't redirecting properly", "refused to connect", "server not found", "hmm. we're having trouble finding that site.", "check your internet connection", "no internet", "dns_probe_finished_nxdomain", "err_connection_refused", "err_connection_timed_out", "err_name_not_resolved", "err_too_many_redirects", "err_blocked_by_client", "err_ssl_protocol_error", "err_empty_response",
    # other languages
    "fehler 404: seite nicht gefunden.", "die angeforderte seite wurde nicht gefunden.", "diese seite existiert nicht.", "zugriff verweigert.", "sie haben keine berechtigung, diese seite anzuzeigen.", "ihre sitzung ist abgelaufen. bitte melden sie sich erneut an.", "bitte melden sie sich an, um fortzufahren.", "der dienst ist vorübergehend nicht verfügbar. bitte versuchen sie es später erneut.", "interner serverfehler", "es ist ein fehler aufgetreten.", "es ist ein unerwarteter fehler aufgetreten. bitte laden sie die seite neu.", "wartungsarbeiten. wir sind bald wieder da.", "diese seite wird gerade gewartet.", "bitte bestätigen sie, dass sie kein roboter sind.", "zu viele anfragen.", "zeitüberschreitung der anfrage.", "die verbindung zur datenbank konnte nicht hergestellt werden.", "dieser inhalt ist nicht verfügbar.",
    "erreur 404 : page introuvable.", "la page demandée est introuvable.", "cette page n'existe pas.", "accès refusé.", "accès interdit. vous n'avez pas l'autorisation d'accéder à cette page.", "votre session a expiré. veuillez vous reconnecter.", "veuillez vous connecter pour continuer.", "service momentanément indisponible. veuillez réessayer plus tard.", "erreur interne du serveur", "une erreur est survenue.", "une erreur inattendue s'est produite. veuillez recharger la page.", "site en maintenance. revenez plus tard.", "confirmez que vous n'êtes pas un robot.", "trop de requêtes.", "délai d'attente dépassé.", "ce contenu n'est pas disponible.",
    "error 404: página no encontrada.", "la página solicitada no existe.", "no se ha encontrado la página.", "acceso denegado.", "no tiene permiso para acceder a esta página.", "su sesión ha caducado. inicie sesión de nuevo.", "inicie sesión para continuar.", "servicio no disponible temporalmente. inténtelo más tarde.", "error interno del servidor", "se ha producido un error.", "ha ocurrido un error inesperado. vuelva a cargar la página.", "sitio en mantenimiento. vuelva más tarde.", "confirme que no es un robot.", "demasiadas solicitudes.", "tiempo de espera agotado.", "este contenido no está disponible.",
    "ошибка 404. страница не найдена.", "запрошенная страница не существует.", "доступ запрещён.", "у вас нет прав для просмотра этой страницы.", "ваша сессия истекла. войдите снова.", "сеанс истёк. пожалуйста, авторизуйтесь.", "войдите, чтобы продолжить.", "сервис временно недоступен. повторите попытку позже.", "внутренняя ошибка сервера", "произошла ошибка.", "произошла непредвиденная ошибка. обновите страницу.", "ведутся технические работы. зайдите позже.", "сайт на обслуживании.", "подтвердите, что вы не робот.", "слишком много запросов.", "превышено время ожидания.", "материал недоступен.",
    "404 ページが見つかりません。", "お探しのページは見つかりませんでした。", "このページは存在しません。", "アクセスが拒否されました", "このページを表示する権限がありません。", "セッションの有効期限が切れました。再度ログインしてください。", "ログインしてください。", "サービスは一時的に利用できません。しばらくしてから再度お試しください。", "サーバーエラーが発生しました。", "エラーが発生しました。", "予期しないエラーが発生しました。ページを再読み込みしてください。", "メンテナンス中です。しばらくお待ちください。", "ロボットではないことを確認してください。", "リクエストが多すぎます。", "タイムアウトしました。", "このコンテンツは利用できません。", "読み込み中...",
)


def prompts() -> list[str]:
    """Written-out prompts with each of their names."""
    return [f.format(n) for forms, names in PROMPTS for f, n in itertools.product(forms.split("|"), names.split("|"))]


def placeholders() -> list[str]:
    made = [f"{a}{n}{b}" for n, (a, b) in itertools.product(FIELD_NAMES, MARKS)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    bare = [f for m in BARE for c in letters for f in (f"{c} {m} ", f" {m} {c}", f"{c} {m},")]
    return made + bare * 2 + [p for p in PLACEHOLDERS for _ in range(8)]


def prompts_and_phrases() -> list[str]:
    """What stands in words rather than between marks."""
    return prompts() * 2 + [p for p in PLACEHOLDERS for _ in range(4)]


def typed() -> list[str]:
    """Aimless typing: runs along keyboard rows, both ways, whole and in repeated parts."""
    out = []
    for row in KEYS:
        for r in (row, row[::-1]):
            out += [r, f"{r} {r}", *(" ".join([r[i : i + n]] * 3) for n in (3, 4, 5) for i in range(len(r) - n + 1))]
            out += [r[i : i + 4] * 3 for i in range(len(r) - 3)]
    return out


def filler() -> list[str]:
    words = LATIN.split()
    # neighbours at several distances, so that the model knows the words in any order
    mixed = [" ".join(words[i::k] + words[:i:k]) for k in (1, 2, 3, 5, 7) for i in range(min(k, 3))]
    return mixed + [f for f in FILLER for _ in range(4)] + typed()


def stand_ins() -> list[str]:
    return [f.format(a=a, n=n) for a, n, f in itertools.product(STAND_INS, STOOD_FOR, STAND_IN_FORMS)]


def notices() -> list[str]:
    scripts = []
    for s in SCRIPT_NOTICES:
        own = next((v for k, v in SCRIPT_NAMES.items() if k == _language(s)), SCRIPT_WORDS)
        scripts += [s.replace("{}", w) for w in own]
    pages = []
    for h, f in itertools.product(HTTP, HTTP_FORMS):
        c, t = h.split(" ", 1)
        pages.append(f.replace("{}", h).replace("{c}", c).replace("{t}", t).replace("{u}", t.replace(" ", "_")))
    return scripts + pages + [n for n in NOTICES for _ in range(8)]


def _language(notice: str) -> str:
    """Of a script notice, by words that only its language has."""
    marks = {"ja": "ページ サイト ブラウザ 有効 オフ", "ru": "в вашем браузере|чтобы|для ", "de": "bitte |seite|ihrem", "fr": "veuillez|cette page|ce site|votre navigateur", "es": "para continuar|navegador|esta página|este sitio"}
    for lang, words in marks.items():
        if any(w in notice for w in words.split("|" if "|" in words else " ")):
            return lang
    return "en"


# Marks that ordinary writing has, too, and words between them; sentences around them.
NATURAL_MARKS = (("{", "}"), ("[", "]"), ("(", ")"), ("<", ">"), ("</", ">"), ("<", "/>"), ("_", "_"), *[("__", "__")] * 4, *[("*", "*")] * 2, *[("**", "**")] * 4, ("~", "~"), ("«", "»"), ("„", "“"), ("【", "】"), ("「", "」"), ("（", "）"), ("&", ";"), ("#", ""), ("$", ""), ("%", ""), ("@", ""), (":", ":"), ("-", "-"), ("`", "`"), ("|", "|"))
NATURAL_WORDS = (
    "so to speak|really|very|see photo|sic|update|update: still fine|edit: it works|note: see below|press enter|edit|my opinion|for me|and how|laughs|not|two years later|b|br|i|strong|em|p|nbsp|amp|quot|smile|wichtig|siehe bild|nachtrag|leider|wirklich|toll|mon avis|vraiment|en bref|édité|de verdad|ver foto|nota|por fin|важно|см. фото|правда|кстати|重要|追記|写真|本当|US|EUR|a_b_c|e.g.|12|5 / 5"
).split("|")
NATURAL_FORMS = ("{}", "i think {} it is fine", "{} it works well", "the lid, {}, was loose", "good {}.", "ich finde {} gut", "c'est {} bien", "es {} bueno", "это {} хорошо", "これは{}良い")
NATURAL_SHORT = (
    "good|very good|great product|works fine|as described|happy with it|i am content with it|muy contento|estoy contenta|buen producto|muy bueno|todo bien|très content|je suis contente|très bien|rien à dire|sehr gut|bin zufrieden|alles bestens|funktioniert|хорошо|отлично|всё работает|доволен|очень доволен|満足です|とても良い|問題なし|the test was positive|i tested it twice|for example|"
    "a sample was included|the text is easy to read|the page is torn|the error is mine|the server in the restaurant|please read the manual|the content of the box was complete|the description was right|the title says it all|my name is on the label|write your name on the label|insert the battery and close the lid|the date on the box|enter the room|the link to the manual works|it is not found in shops here|"
    "access to the filter is easy|maintenance is simple|the session lasted an hour|i accept that|der test verlief gut|der text ist gut lesbar|die seite ist zerrissen|beispielsweise|la page est déchirée|par exemple|le texte est lisible|por ejemplo|la página está rota|например|страница порвана|たとえば"
).split("|")

# Ordinary sentences, so that a small corpus, too, knows the common words of its languages.
NATURAL_SENTENCES = (
    "we had it for a while and everybody in the house uses it|it does what it should and was easy to set up|the box came on time and nothing was missing|i would have liked a longer cable but that is a small thing|after a few weeks the colour has faded a little|you have to read the instructions before you start|my daughter wanted another one for her room|the people in the shop were kind and answered every question|"
    "he is learning javascript at school|the course teaches javascript and a little design|the scripts for the play are on the shelf|we ate cookies on the way|er lernt javascript in der schule|elle apprend javascript à l'école|ella aprende javascript en la escuela|она учит javascript в школе|в курсе есть javascript и немного дизайна|学校でjavascriptを習っています|le casque audio est au top|"
    "there is a button on the side that turns the light on and off|it was not what i had in mind, so i sent it back|the service was quick and the price is fair|the system needs a moment to start, then it runs well|you can see on the page how the parts fit together|i was able to change the settings in the menu without help|"
    "wir haben es seit einiger zeit und alle im haus benutzen es|es tut, was es soll, und war leicht aufzubauen|das paket kam pünktlich und es fehlte nichts|nach ein paar wochen ist die farbe etwas blasser geworden|man muss vor dem anfang die anleitung lesen|meine tochter wollte noch eines für ihr zimmer|die leute im laden waren freundlich und haben jede frage beantwortet|der dienst war schnell und der preis ist in ordnung|auf der seite sieht man, wie die teile zusammenpassen|das gerät braucht einen moment, dann läuft es|"
    "nous l'avons depuis un moment et toute la maison s'en sert|il fait ce qu'il doit et il était facile à monter|le colis est arrivé à l'heure et rien ne manquait|après quelques semaines la couleur a un peu passé|il faut lire la notice avant de commencer|ma fille en voulait un autre pour sa chambre|les gens du magasin étaient aimables et ont répondu à tout|le service a été rapide et le prix est juste|on voit sur la page comment les pièces s'assemblent|le texte du livre est simple et les images sont belles|il apprend la langue avec un livre|"
    "lo tenemos desde hace tiempo y todos en casa lo usan|hace lo que debe y fue fácil de montar|el paquete llegó a tiempo y no faltaba nada|después de unas semanas el color se ha apagado un poco|hay que leer las instrucciones antes de empezar|mi hija quería otro para su habitación|la gente de la tienda fue amable y contestó a todo|el servicio fue rápido y el precio es justo|en la página se ve cómo encajan las piezas|el texto del libro es sencillo y las fotos son bonitas|la prueba duró una semana y todo fue bien|"
    "мы пользуемся им уже давно, и всем в доме нравится|он делает то, что нужно, и собрать его было легко|посылка пришла вовремя, ничего не пропало|через несколько недель цвет немного потускнел|перед началом надо прочитать инструкцию|дочь захотела такой же в свою комнату|люди в магазине были приветливы и на всё ответили|обслуживание быстрое, и цена честная|на странице видно, как соединяются части|текст в книге простой, и картинки красивые|для дома это самое то, не шумит и не греется|"
    "家族みんなで長く使っています|思った通りに動き、組み立ても簡単でした|荷物は時間通りに届き、足りない物はありませんでした|数週間で色が少し薄くなりました|始める前に説明書を読む必要があります|娘も自分の部屋に欲しがっています|店の人は親切で、何でも答えてくれました|対応が早く、値段も手頃です|ページを見れば部品の付け方が分かります|本の文章はやさしく、写真もきれいです|この機械は少し待つと動きます"
).split("|")


def natural() -> list[str]:
    """Ordinary writing that has marks and words in common with residue."""
    marked = [f.format(f"{a}{w}{b}") for (a, b), w, f in itertools.product(NATURAL_MARKS, NATURAL_WORDS, NATURAL_FORMS)]
    return marked + [s for s in NATURAL_SHORT for _ in range(40)] + [s for s in NATURAL_SENTENCES for _ in range(40)]


def in_context(texts: list[str]) -> list[str]:
    """Placeholders among words, for the shapes around them; round brackets are as common in ordinary writing."""
    return [f.replace("|", t) for t in texts if t[0] not in "(（" for f in ("word | word", "word |, word", "| word", "word |.", "word: |", "word, | word", "|", "語|語", "|語", "語|。")]


#: Each model with its seeds.
CLASSES = {"placeholder": placeholders, "prompt": prompts_and_phrases, "filler": filler, "stand_in": stand_ins, "notice": notices}
