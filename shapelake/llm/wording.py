"""The wording of error pages, script notices, filler and instructions, as lists and patterns of the languages.

Sources: the reason phrases of HTTP (RFC 9110 and its registry), the default pages of common web servers,
frameworks and content delivery networks, the usual noscript notices, and the common forms of filler and of
prompts in forms and layouts. Nothing here is taken from a corpus. All text is lower case, as texts are
normalized before they are matched. The lists are parameters of bounded size.
"""

from __future__ import annotations

import re

# ---- messages. A sentence is a message if one of these patterns holds in it; each names literals one of which
# any match contains, for the automaton.

# Reason phrases of HTTP status codes, as far as they say that a request failed.
REASONS = """bad request; unauthorized; payment required; forbidden; not found; method not allowed; not acceptable; proxy authentication
required; request timeout; request time-out; conflict; gone; length required; precondition failed; content too large; payload too large;
uri too long; request-uri too long; unsupported media type; range not satisfiable; expectation failed; misdirected request;
unprocessable content; unprocessable entity; locked; failed dependency; too early; upgrade required; precondition required; too many
requests; request header fields too large; unavailable for legal reasons; internal server error; internal error; server error; not
implemented; bad gateway; service unavailable; gateway timeout; gateway time-out; http version not supported; insufficient storage; loop
detected; network authentication required; connection refused; connection reset; connection timed out"""
REASON_LIST = [" ".join(x.split()) for x in REASONS.split(";")]

# Subjects and failures of error sentences; a sentence with both is a message.
_SUBJECT = {
    "en": r"pages?|sites?|websites?|servers?|services?|requests?|resources?|urls?|address|links?|sessions?|files?|documents?|connections?|gateway|proxy|backend|"
    r"upstream|host|database|app|application|account|login|log-?in|sign-?in|token|key|object|content|report|record|item|preview|view|something|it|this|that|we|you|"
    r"access|error|problem|queue|slots?|workers?|captcha|ip|traffic|case|entry|article|post|product|section|workspace|system",
    "de": r"seite|webseite|website|server|dienst|anfrage|adresse|link|sitzung|datei|dokument|verbindung|zugriff|zugang|fehler|problem|inhalt|anwendung|konto|anmeldung|sie|es|etwas|berechtigung",
    "es": r"página|sitio|servidor|servicio|solicitud|recurso|dirección|enlace|sesión|archivo|documento|conexión|acceso|error|problema|contenido|aplicación|cuenta|algo|permiso",
    "fr": r"page|site|serveur|service|requête|ressource|adresse|lien|session|fichier|document|connexion|accès|erreur|problème|contenu|application|compte|vous|nous|quelque chose|autorisation",
    "it": r"pagina|sito|server|servizio|richiesta|risorsa|indirizzo|collegamento|sessione|file|documento|connessione|accesso|errore|problema|contenuto|applicazione|account|qualcosa",
    "pt": r"página|site|servidor|serviço|pedido|solicitação|recurso|endereço|link|sessão|arquivo|ficheiro|documento|conexão|ligação|acesso|erro|problema|conteúdo|aplicativo|conta|algo",
    "nl": r"pagina|site|website|server|dienst|verzoek|bron|adres|link|sessie|bestand|document|verbinding|toegang|fout|probleem|inhoud|toepassing|account|er|u",
    "ru": r"страниц\w*|сайт\w*|сервер\w*|сервис\w*|служб\w*|запрос\w*|ресурс\w*|адрес\w*|ссылк\w*|сесси\w*|файл\w*|документ\w*|соединени\w*|доступ\w*|ошибк\w*|проблем\w*",
}
_FAILURE = {
    "en": r"not (?:be )?found|(?:can't|cannot|can not|couldn't|could not|unable to|not able to|failed to|didn't|did not|doesn't|does not|don't|do not|isn't|is not|are not|has not|"
    r"wasn't|was not|no longer|not) (?:find|locate|be|exist|exists|available|have (?:permission|access)|allowed|authori[sz]ed|respond|here|reach|connect|load|loaded|complete|process|"
    r"handle|understand|retrieve|open|display|service|match|work|working|valid)|(?:un|not )available|unreachable|denied|refused|expired|(?:went|gone|go|is) wrong|(?:technical|connection|some|experiencing) (?:difficult|issue|problem)\w*|took too long|(?:login|log-?in|sign-?in|authentication|registration|subscription|permission|access) (?:is )?required|(?:have|has|had) expired|not support\w*|(?:exception|failure|crash|outage) (?:has|occurred|was)|broke|timed[ -]?out|time-?out|"
    r"too long|too many|rate[ -]limit\w*|blocked|banned|moved|removed|deleted|renamed|archived|retired|(?:is|are|be|currently|temporarily) (?:down|offline|closed|busy|full|overloaded|restricted)|"
    r"down for|maintenance|no such|no valid|invalid|malformed|misconfigur\w*|unexpected(?:ly)?|overloaded|busy|is full|"
    r"(?:have|has|had|been|encountered|experiencing|occurred) (?:an? |some )?(?:\w+ )?(?:error|problem|issue|trouble)\w*|(?:error|problem|issue)s? (?:has |have )?(?:occurred|happened|while|processing)|"
    r"try again|come back|check back|sign in again|log in again|permission|disallowed|prohibited|suspended|crashed|conflict|nothing (?:was )?(?:found|here)|need to (?:sign|log) in|must (?:sign|log) in|be logged in|has (?:been )?(?:moved|changed|gone|left)|(?:is|are) missing|page missing",
    "de": r"nicht (?:gefunden|verfügbar|erreichbar|vorhanden|mehr|erlaubt|möglich|geladen|angezeigt|gestattet|berechtigt|beantwortet|bearbeitet)|existiert|verweigert|gesperrt|abgelaufen|fehlgeschlagen|"
    r"aufgetreten|schiefgelaufen|schief gelaufen|wartung\w*|überlastet|zu viele|zu lange|versuchen sie|später|keine (?:berechtigung|rechte|verbindung|antwort)|wartungsarbeiten|ungültig|entfernt|verschoben|gelöscht|unterbrochen|gestört|abgelehnt",
    "es": r"error (?:interno|inesperado|desconocido)|no (?:encontrad[oa]|existe|disponible|se (?:ha |pudo |puede )?(?:encontr\w+|cargar|mostrar|procesar)|está disponible|responde|válid[oa]|permitid[oa]|tiene)|no se encuentra|denegad[oa]|rechazad[oa]|"
    r"caducad[oa]|expirad[oa]|ha (?:caducado|expirado|ocurrido|fallado)|salió mal|salido mal|mantenimiento|inténtelo|inténtalo|intente|demasiad[oa]s|tardó demasiado|prohibid[oa]|eliminad[oa]|movid[oa]|sobrecargad[oa]|de nuevo",
    "fr": r"introuvable|en maintenance|a expiré|reconnecter|non (?:autorisée?|trouvée?|disponible)|n'existe (?:pas|plus)|n'a (?:pas|plus)|n'est (?:pas|plus)|pas (?:trouvée?|disponible|autorisée?|accessible)|ne (?:répond|peut|pouvons|fonctionne)|impossible|indisponible|inaccessible|refusée?|expirée?|interdite?|"
    r"s'est produite?|survenue?|mal passé|maintenance|réessaye[rz]|trop (?:de|longtemps)|invalide|supprimée?|déplacée?|échoué|surchargé|panne",
    "it": r"errore (?:imprevisto|interno|sconosciuto|generico)|non (?:trovat[oa]|esiste|disponibile|è (?:stat[oa]|disponibile|più)|autorizzat[oa]|valid[oa]|risponde|raggiungibile)|impossibile|negat[oa]|rifiutat[oa]|scadut[oa]|vietat[oa]|verificat[oa]|andato storto|"
    r"manutenzione|riprova\w*|tropp[eoia]|rimoss[oa]|spostat[oa]|eliminat[oa]|sovraccaric[oa]|irraggiungibile",
    "pt": r"erro (?:interno|inesperado|desconhecido)|faça login|novamente|não (?:encontrad[oa]|existe|disponível|foi (?:possível|encontrad[oa])|está disponível|autorizad[oa]|tem|responde|pôde|pode)|indisponível|negad[oa]|recusad[oa]|expirad[oa]|expirou|proibid[oa]|ocorreu|deu errado|"
    r"correu mal|manutenção|tente|demasiad[oa]s|muit[oa]s (?:pedidos|solicitações)|removid[oa]|movid[oa]|excluíd[oa]|sobrecarregad[oa]|inválid[oa]",
    "nl": r"log opnieuw|opnieuw in|niet (?:gevonden|beschikbaar|bereikbaar|bestaat|toegestaan|worden|meer|geladen|geldig)|bestaat niet|geweigerd|verlopen|verboden|opgetreden|misgegaan|mis gegaan|onderhoud|probeer|te veel|te lang|verwijderd|verplaatst|overbelast|ongeldig|geen toegang",
    "ru": r"не (?:найден\w*|существует|доступ\w*|отвечает|удалось|может|разрешен\w*|работает)|недоступ\w*|запрещ[её]н\w*|отказан\w*|ист[её]к\w*|произошла|обслуживани\w*|попробуйте|повторите|слишком|удал[её]н\w*|перемещ[её]н\w*|перегружен\w*|устарел\w*",
}
# Scripts and cookies, and what is said of them in notices.
_SCRIPT = r"javascript|java script|\bjs\b|client-side scripts?|scripts?|scripting|cookies?|skripte|scripte|skripten|guiones|secuencias de comandos|scripts|cookie|скрипт\w*|スクリプト|クッキー|脚本|자바스크립트|쿠키"
_SWITCH = (
    r"enabl\w+|activat\w+|turn(?:ed|ing)? (?:[\w-]+ ){0,3}o(?:n|ff)|switch(?:ed)? (?:[\w-]+ ){0,3}o(?:n|ff)|allow\w*|requir\w+|needs?|needed|disabled|without|block\w+|supports?|(?:not|doesn't|does not) support|unsupported|must (?:be|have)|have (?:\w+ )?(?:enabled|turned on)|not (?:run|available|supported|enabled)|"
    r"does not run|doesn't run|only (?:in|with)|help us|is off|are off|best with|work\w* properly|"
    r"unterstützt|admite|soporta|supporte|prend pas en charge|supporta|suporta|ondersteunt|поддерживает|aktivier\w*|deaktiviert|abgeschaltet|ausgeschaltet|eingeschaltet|einschalten|benötigt\w*|erforder\w*|braucht|erlauben|zulassen|ohne|"
    r"activ\w+|habilit\w+|desactivad\w*|deshabilitad\w*|necesit\w+|requier\w+|permit\w+|sin|"
    r"désactivée?s?|nécessit\w+|nécessaires?|requis\w*|autoris\w+|sans|attiv\w+|abilit\w+|disattivat\w*|disabilitat\w*|richied\w+|necessari\w+|senza|consent\w+|"
    r"ativ\w+|desativad\w*|desabilitad\w*|precisa\w*|necess[áa]ri\w+|requer\w*|sem|"
    r"inschakel\w*|ingeschakeld|uitgeschakeld|schakel|vereist|nodig|zonder|toestaan|"
    r"включ\w+|отключ\w+|выключ\w+|необходим\w*|требу\w+|нужен|разреш\w+|без|"
    r"有効|無効|必要|許可|オフ|オン|启用|啟用|开启|開啟|禁用|需要|允许|활성화|필요|사용"
)
_CHECK = (
    r"(?:check|verif|confirm|secur|review|prov|inspect|analy[sz])\w* (?:if |that |whether |the |your |you(?:'re| are)? |security of your )*(?:site |web ?)?(?:browser|human|connection|identity|not a robot|robot|device)|"
    r"(?:oops|whoops|uh[ -]oh|ups|ой)(?=[!.,… ]|$)|(?:you are|you're|are you|i'm|i am|not) (?:not )?(?:a )?(?:human|robot|bot)|complete (?:the|a|this) captcha|captcha|ddos protection|ray id|just a moment|one moment(?:,? please)?|"
    r"please (?:wait|stand by|hold on)|redirect(?:ed|ing)? (?:you )?(?:shortly|automatically|in)|will redirect|this process is automatic|security (?:check|service)|"
    r"(?:überprüf|prüf|verifizier)\w* .{0,20}(?:browser|mensch|verbindung)|einen moment|bitte warten|(?:comprob|verific|revis)\w+ .{0,20}(?:navegador|humano|robot|conexión)|espere|un momento|"
    r"(?:vérifi|contrôl)\w+ .{0,25}(?:navigateur|humain|robot|connexion)|veuillez patienter|un instant|(?:verific|controll)\w+ .{0,20}(?:browser|umano|robot|connessione)|attendere|"
    r"(?:verific|checa)\w+ .{0,20}(?:navegador|humano|robô|conexão)|aguarde|(?:controle\w*|verifi\w+) .{0,20}(?:browser|mens|verbinding)|even geduld|een ogenblik|"
    r"(?:провер\w+) .{0,20}(?:браузер\w*|человек\w*|робот\w*|соединени\w*)|подождите"
)
_CODE = r"(?:^|[\s(>\"'#:])(?:(?:error|http|status|code|fehler|erreur|errore|erro|fout|ошибка|エラー|错误|錯誤)[ :#\-–]*(?:code|status|error|http|/?[12]\.[01])?[ :#\-–]*[345]\d\d\b(?:\.\d+)?|[45]\d\d (?:[-–—:|/] ?)?(?:error|fehler|erreur|errore|erro|fout|ошибка|エラー))"

# East Asian sentences have no word boundaries, so their messages are phrases.
ASIAN_MESSAGES = [
    # Japanese
    "見つかりません", "見つかりませんでした", "存在しません", "エラーが発生", "エラーです", "アクセスが集中", "アクセスできません", "アクセスが拒否", "アクセス権", "権限がありません", "表示する権限", "拒否されました", "表示できません",
    "表示することができません", "接続できません", "利用できません", "ご利用いただけません", "お使いいただけません", "有効にして", "有効にする必要", "無効になって", "ブラウザを確認", "ロボットではない", "しばらくお待ち", "お待ちください", "再度お試し",
    "もう一度お試し", "やり直して", "ログインし直し", "再度ログイン", "期限が切れ", "有効期限", "タイムアウト", "メンテナンス中", "混み合って", "混雑して", "移動または削除", "削除された可能性", "応答がありません", "読み込めません",
    # Chinese
    "找不到", "未找到", "不存在", "无法访问", "无法显示", "无法打开", "無法訪問", "無法顯示", "拒绝访问", "訪問被拒", "访问被拒绝", "没有权限", "無權", "无权", "服务器错误", "内部错误", "伺服器錯誤", "出错了", "出現錯誤", "请启用", "請啟用", "请开启",
    "稍后再试", "稍后重试", "稍後再試", "正在维护", "维护中", "維護中", "正在检查", "正在验证", "检查您的浏览器", "请稍候", "請稍候", "会话已过期", "已过期", "超时", "请求过多", "请求过于频繁", "服务不可用", "暂时不可用",
    # Korean
    "찾을 수 없", "존재하지 않", "접근 권한", "접근이 거부", "권한이 없", "오류가 발생", "서버 오류", "활성화하", "활성화해", "사용할 수 없", "잠시 후 다시", "다시 시도", "점검 중", "만료", "기다려 주",
]
# What may stand beside such a phrase in a text of nothing but messages.
ASIAN_COURTESY = r"(?:ください|下さい|주세요|십시오)$|^(?:请|請)"

# Words of web messages, and the small words between them; what of a text they cover is no content. Named by language.
_VOCABULARY = {
    "en": """accept active actually additional address administrative advice allowing appear appears appreciate apologies apologize apologise attempt attempting attempts attention authenticated authentication authorization authorized bad based
    beyond bookmark bots busy cached cannot capacity case caused changed character characters choose closed compatible completing conditions configuration configured confirm console continuing country crash created credentials critical
    currently data database days delete deleting detected developer difficulties directly displayed disconnected doing domain down download downtime during duplicate empty enabling endpoint ensure exceeded exception executing existing experience experiencing expect extension
    external failure fails feature fetch files fix fixed forgot format forward gone great hang happening hours image immediately improve inactive inactivity inconvenience incompatible indicated installed interrupted invalid investigating issues item join
    language latest launch left length like limited line list listed local location locate locked longer lookup malformed match matching member method mode modify navigate navigated network occurred occur opening outage overloaded parameter parameters part
    patience payload pending please plugin preferences present previous privacy private proceed processing production protect protected protection provide public query quickly quota reached read ready reconnect recent regarding region rejected related
    released renamed replaced reporting repeated resolve resolved resource restart restore restricted resume resubmit retrieve retrieving review rights route safe save saved schema secure seem select sending setting shortly show sign signal simply slow slightly software
    solve source space specific spelling standard stand still store submit submitted subscribe subscription success suggest supports suspicious syntax tab technical terminated terms thank thanks throttled timeout title today together tools top trace traffic
    transferred typed typing unauthorized unknown unreachable unresponsive unsupported upgrading valid value values various verification verifying viewing violation visited visiting waiting warning whoops window withdrawn write wrote
    ad ads adblock adblocker advertising blocker extensions firewall vpn popup popups reload connected offline online wifi internet dns hostname certificate ssl tls
    a about above access account action again all allow allowed already also am an and another any anything app application are as asked at automatically
    available back be because been before below best better blocked broke browser browsers but by button cache call can can't cannot check checking clear click client close
    code come complete connect connection contact content continue cookie cookies correct correctly could couldn't currently customer deleted denied description detail details
    device did didn't different directory disabled do document does doesn't don't down due either email enable enabled encountered enter error errors exist exists expired
    failed few file find first followed following for found from full fulfilling further gateway get give go going got had happened has have haven't help here hidden home host how however human
    id if in incident incorrect information inform instead internal into invalid is isn't issue it its javascript js just keep key know later let link links load loaded loading log
    logged login logs look looking lost made maintenance make mask may maybe message might minute minutes mistyped moment more moved must name need needed needs new no noscript not nothing now number object
    of off offline old on once one only oops open opened or order other our out outdated own page pages password path perform performed permission permissions place please planned point
    policy possible prevented preventing problem problems process properly provided proxy reach reached reason received redirect redirected reference refresh reload remove removed
    report request requested requests required requires resource resources respond responding response result retry return returned right robot run running scheduled script scripting
    scripts search second seconds security see seems send sent server servers service services session set should show shown sign signed site sites so some something soon sorry
    specified start started stay stays status stop stopped string such support supported sure switch switched system take takes team technical tell temporarily temporary than that that's the their them then
    there these they thing things this those time timed to token too tried trouble try trying turn turned type uh unable unavailable under understand unexpected unfortunately unknown until up updated upgrade uri url us
    use used user using valid verify version view visit wait was way we we're web website went what when where which while who why will with within without work working works
    would wrong yet you you're your yours""",
    "de": """aktiviert aktivieren aktuell aktualisieren anmeldung anmelden anzeigen anzuzeigen arbeiten ausgeführt authentifizierung bald bearbeitet bearbeitung beantworten beendet behoben bekannt berechtigungen bereits besteht betreiber daten datei derzeit einmal einstellungen
    entschuldigen entschuldigung erhalten erlauben erreichbar erreichen erst falsch fehlerhaft fehlermeldung fortfahren fortzufahren funktioniert funktionieren geben gerade gesucht gesuchte gesuchten gültig hilfe inhalte internet jetzt kehren klicken konto korrekt ladefehler
    leider lösen manuell melden mindestens minuten moderne momentan müssen muss nachricht neue nochmals nutzen nutzung nutzer ordnungsgemäß passwort produkt richtig richtige schließen schon sekunden sicher sicherheit sobald sollte sondern stehen steht support technische
    technischer überlastet überprüfen unbekannt unbekannter ungültige unerwartet unterstützt update verbindung vermutlich verständnis versuch verweigert vielen dank vollständig vorgenommen wartungsarbeiten webseite website weiterleitung weitere wende wollen ziel zugreifen zulassen zuvor
    aber alle als an anderen anfrage angeforderte angeforderten anmelden anwendung auch auf aufgerufene aufgetreten aus bei beim benötigt berechtigung besuchen bitte browser cookies das dass dem
    den der des die dienst dies diese diesen dieser dieses du durch ein eine einem einen einer eingegebene entfernt er erforderlich erneut es etwas existiert fehler für gefunden gehen gelöscht geladen hat
    haben hier ich ihr ihre ihrem ihren im in inhalt interner ist ja javascript kann keine kein konnte können kontaktieren laden leider link mehr melden mit moment möchten nach neu nicht noch oder ohne
    problem prüfen seite seiten server serverfehler sich sie sind sitzung skripte später startseite suche tut uns um und unerwarteter ungültig unter verfügbar verschoben versuchen verwenden von vorgang vorübergehend
    warten wartung warten war was wegen weiter wenden wenn werden wie wieder wir wird wurde zu zugriff zum zur zurück zurzeit""",
    "es": """aceptar activar activado activo actual actualizar actualmente administrador admite agotado alguna aquí atrás autorizado autorización ayudar bloqueado brevedad campo cargando cargó cerrar clic código completar comprobar conectar configuración consulta continuar contenido contraseña
    correcta correctamente correo creemos datos debe deben denegado desactivar dificultades disponible disculpas durante ejecutar eliminado encontró encontramos encuentra encontrar escriba esperar espere estamos existen experimentando falló fue función habilitado habilite haga hora identificado inesperado
    inicia iniciar instante intentar intentarlo internet lamentable minutos molestias momentáneamente nada necesario nueva nuevamente obtener otra otro palabra permite plazo podido podemos pruebe pudo puedes queda realizar recargar recargue recuperar red regrese regresar requerido requiere resolver
    respuesta revise segundos seguridad seguir siguiente sistema solicitar soporte también técnica técnico técnicos tiempo todavía tomar trabajando trabajo trate usar usuario utiliza válida varios vez volver
    a acceder acceso actualice al algo ahora antes aplicación archivo asegúrese ayuda busca buscando caducado cargar compruebe con conexión contacte cookies cuenta de del desactivado después dirección disculpe
    disponible donde el ella en enlace error escrito es esta está este esto existe favor funcionar ha haber habilitar hay inicie inicio intente inténtelo interno javascript la las le lo lamentamos los más mientras momento
    más mostrar navegador necesita no nos nuestro nuevo o ocurrido página para permiso permisos pero por problema procesar puede que recurso sentimos se ser servicio servidor sesión si sido sin sitio sitio
    solicitada solicitado solicitud son su sus tarde temporalmente tiene un una usted utilizar válido ver verifique vuelva y ya""",
    "fr": """accepter accepté actif activé activée activer actuellement actualiser adresse afin aide ailleurs attendre attente authentification bientôt bloqué bloquée bouton cause chargée chargé charger cliquer cliquez code compris configuration connectez connecté consulter contenu contient continuer correct corrigé
    cours déconnecté délai demande demander dernière détails deux difficultés disponibles données dû effectuer également encourus entrez erronée essayez essayons êtes expiré expirée faire fermer fonctionnalité fonctionnement formulaire gêne hors identifiant identifier inactif incident inconnu indisponible indiquée
    informations instants introuvable jour ligne limite long longue maintenance manuellement mauvaise message mettre mise minutes modifiée moins mot nécessaire nécessite nouvelle occasionnée oublié paramètres passe passé patience patienter permet permission personne peu pouvoir pourquoi présente prend prenons prochainement
    raison réactualiser reconnecter rencontré rencontre réseau résoudre retard réponse revenez revenir saisie saisi sécurité sera simplement souhaitée sommes suite support supprimée technique techniques temps tentative terminée tous trop trouve utilisateur utilisez valide validé vérifier voulez vouloir
    a accéder accès accueil actualisez administrateur afficher ailleurs application au aucun autorisation avez avoir ce cela cette ces chargement cherchez choses compte connecter connexion contacter cookies d dans de demandée
    demandé des désolé désolés droit du elle en encore erreur essayer est et été être exister fichier fonctionner fonctionne il ici impossible incorrecte inattendue interne internet javascript je l la le les lien leur lors mais merci
    moment n navigateur ne n'est nous notre nouveau ou oups page par pas peut plus pour pourrait pouvez problème produite qu que quelques qui quelque rechargez recherche recherchez requête ressource retour retourner revenir s sa se serveur service ses session
    si site son suivre sur survenue tard temporairement toutes trouver trouvée un une utiliser veuillez vérifiez vers visiter voir vos votre vous y à""",
    "it": """abilitato abilitare accedere accesso accetta account aggiornare aggiorna aiuto amministratore ancora assistenza attendi attenzione attivare attivo attualmente autorizzato autorizzazione bloccato breve caricamento caricare cercando cercare cerca chiudi clicca codice completare configurazione connettersi consentire contenuto
    continuare controlla corrente corretto corso credenziali dati desiderata difficoltà disabilitato disagio disponibile domanda dovuto durante effettuare elaborare elaborazione entra esaurito esegui eseguire eseguito fai fallito fare funzionare funzione funzionalità generico già identificare imprevisto inattività indietro
    informazioni inserito inserire interno interrotto lavori limite manutenzione messaggio minuti momentaneamente negato nessun nessuna nome nuovamente nuovo numero ora password permesso permessi persistere persiste possiamo potete presente presto preghiamo procedere qui raggiungibile rete ricarica ricaricare ricevuto rimosso risolvere risposta
    risultato ritenta scadenza scaduta scaduto scusiamo secondi seguito selezionato sicurezza sistema soluzione stesso stiamo supporto tecnico tecnici tempo tentativi tentativo torna troppe troppo trovare utente utilizzando valido verificare verificato verificata vuoi
    a al alla ancora applicazione attendere browser c che ci collegamento con contattare cookie da dal del della delle di dopo errore esiste essere è file gli ha hai home i il in indirizzo interno javascript l la le link lo
    ma momento nel nella non nostro o oppure ops pagina per piacere più poi possibile potrebbe prego problema provare qualcosa questa questo questo richiesta richiesto ricaricare ricerca ripetere riprovare riprova server servizio sessione si siamo sito
    sono spiacenti stai stata stato su sul temporaneamente tornare trovata trovato tua tuo un una utilizzare vai verifica visualizzare""",
    "pt": """aceitar ajuda aguarde alguns algum ainda aplicação atualizar atualmente ativar ativado ative autenticação autorizado bloqueado breve campos carregar carregando causa clique código completar concluir conectar configurações conta contato continuar correta corretamente credenciais dados depois desativado desculpas detalhes devido
    digitou digitado dificuldades disponível durante encontrada encontramos encontrar entrar enviar equipe esperado estamos esgotado executar existir expirada expirado expirou faça fazer fechar feito função funciona habilitado habilite horas houve identificar imprevisto inesperado informações inicial iniciar instantes interrompido internet
    limite login logo manutenção mensagem minutos momentaneamente mudou nada necessário necessária nenhum nome nova novamente novo obter outra outro passou permitido permissões permite persistir pois possui precisa preciso prosseguir próxima pronto quer rede recarregar requer resolver resposta saiu segundos segurança senha sendo
    sistema solicitar suporte suporta técnica técnico técnicos tempo tentativa tentativas tente todos trabalhando usuário utilizador válida válido verificar verificando vez visualizar volte
    a acessar acesso algo ao aplicativo aqui arquivo as atualize até autorização com conexão contate cookies da de desculpe do dos e ela ele em endereço entre erro errado esta está este existe favor foi funcionar início
    interno inválido isso já javascript lamentamos link mais mas mesmo momento na navegador no nós nosso não o ocorreu ou os página para parece pedido pela pelo permissão pode por possível problema procura procurando que
    recarregue recurso retornar se seja sem sentimos ser servidor serviço sessão seu sua site solicitada solicitado sobre tarde temporariamente tentar tente um uma usar utilizar verifique você volte voltar à é""",
    "nl": """aangemeld aanmelden accepteren activeren actief afgebroken allemaal alstublieft andere automatisch beheerders beschikbaar beveiliging binnen blijft code controleer controleren daarna doorgaan eerst enkele ervoor extra fouten functie gaat gebruik gebruiken gebruiker gegevens geldig geplaatst geprobeerd geweigerd goed
    hulp inloggen ingelogd ingeschakeld inhoud instellingen internet juist juiste klik komt kort laatste log lukt misschien moet moeten mogelijk momenteel naam netwerk nieuw nieuwe nodig onbekende onderhoud onderstaande ondersteunt ongeldig ongemak onverwachte opgelost opgevraagde oplossen overbelast sessie snel staat storing
    systeem technische terugkeren toch toegestaan uitvoeren uitgeschakeld verbinding verder verkeerd verlopen vernieuw verwerken verzoeken volgende vereist volledig wachten wachtwoord webpagina wegens werkt wilt worden zodra zorg
    aan aangevraagde adres al als beheerder ben bent bestaat bestand bezoeken bij browser contact cookies dat de deze die dit door een eens en er even fout gaan gebruiken geen gevonden gevraagde haar heb hebben heeft helaas het hier
    homepagina ik in interne is ja javascript je jouw kan kunnen laden later link mag maar meer met moment na naar neem niet nog nu of om onze op opnieuw over pagina probeer probleem server site sorry te terug tijdelijk toegang tot u uit uw van
    verplaatst verwijderd verzoek via voor waar wanneer was we website weer werken wij willen wordt worden zijn zoekt zoeken""",
    "ru": """автоматически авторизации авторизация адреса адресе администратор активировать больше браузером введите введён верно вероятно включен включена возникла возникли войти время все всё выполнить выполняется вход два данные действие действия для доступен доступна дождитесь другой её ещё запроса запрещен запрещён запросов зайти
    здесь извинения имеете имени интернет искали истекла истекло их когда контент корректно логин минут может можно неверный недоступен недоступна недостаточно неизвестная некоторое немного нельзя неправильно непредвиденная несколько новый обновить обратно ожидания ознакомиться отключен отключена отображения отправить ошибки очень пароль перезагрузите
    перегружен пользователь помощь после потребуется поддержки поддерживает поиск права правильно правильный превышен прав приносим проблема проблемы проверка проверку продолжения продолжить проведения произошло просим просмотра просматривать работает работы разделе разрешите ресурс ресурса свяжитесь сделать сейчас сервис сервиса сессия сети скоро
    служба слишком сожалению состояние спустя срок страницей существует счёт технические технических удалось удалена указанный уже устаревшая учётной файл через
    а адрес администратору браузер браузера браузере был была в ваш ваша вашего вашем внутренняя возможно вернитесь вы главную доступ доступа если запрос запрошенная запрошенный и из извините или
    как к которую ли мы на нажмите не необходимо нет но о обновите обратитесь ой она ошибка ошибка перейти по повторите подождите пожалуйста позже попробуйте попытку правильность при проверьте произошла с сайт сайта сервер сервера сервере сети снова ссылка
    ссылке страница страницу страницы такой у убедитесь удалена что чтобы эта эту этого этой javascript""",
}
# What else web messages name: ids and fields of reports, people to turn to, limits.
_REPORTING = """administrator administrators admin owner operator webmaster developer developers support helpdesk team ray trace ref reference incident ticket request requestid correlation title message description
accessdenied nosuchkey nosuchbucket exception type report http https html noscript rate limit limits limited quota upstream worker workers slot slots queue busy workspace dashboard viewer board panel"""
VOCABULARY = frozenset(
    [w for words in _VOCABULARY.values() for w in words.split()] + _REPORTING.split() + [w for x in REASON_LIST for w in x.split()] + [w for words in _SUBJECT.values() for w in words.split("|") if w.isalpha()]
)

# Words of menus and page frames: home, search, imprint and the like.
NAVIGATION = frozenset(
    """about account archive back blog browse cart categories contact content copyright dashboard docs download downloads faq feedback footer forum guide header help home imprint index info jobs language legal list log login logout
    main map members menu navigation news next page pages policy powered press previous print privacy products profile projects register report reports reserved rights save search settings share shop sign sitemap skip start status subscribe support terms
    top tools version welcome server service site all by in out to of and us our this site
    startseite suche hilfe impressum datenschutz kontakt anmelden abmelden menü inicio buscar ayuda contacto privacidad aviso accueil recherche aide contact mentions légales
    apache nginx iis tomcat ubuntu debian centos openresty cloudflare varnish port""".split()
)

REASON = re.compile(r"(?<![\w-])(?:" + "|".join(sorted((re.escape(x) for x in REASON_LIST), key=len, reverse=True)) + r")(?![\w-])")
CODE = re.compile(_CODE)
# Failures that name no subject.
BARE = re.compile(r"^\W*cannot (?:get|post|put|delete) /|(?<!\w)err_[a-z_]+|^\W*we(?:'re| are) sorry\W*$|^\W*(?:(?:temporarily|currently|briefly|sorry,?) )*(?:unavailable|down for|offline)(?!\w)|^\W*error \w+ing |(?<!\w)(?:scheduled|planned|under|undergoing|routine) maintenance(?!\w)")
NOTICE = re.compile(rf"(?<!\w)(?:{_SCRIPT})(?!\w)|スクリプト|クッキー|脚本|쿠키|자바스크립트|(?<=[^a-z])(?:javascript|cookie|js)(?![a-z])")
SWITCH = re.compile(rf"(?<!\w)(?:{_SWITCH})(?!\w)|有効|無効|必要|許可|启用|啟用|开启|開啟|禁用|需要|允许|활성화|필요")
# What such a page tells its reader to do, and that it is loading: no message by itself.
DIRECTIVE = re.compile(
    r"\s*(?:please |then |and |or |you can |you may |try to )*(?:turn (?:it|them) on|enable (?:it|them)|reload|refresh|retry|try|contact|check|return|go (?:back|to)|clear|sign in|log in|click|visit|update|wait|tell|ask|if|"
    r"bitte|por favor|vuelva|veuillez|merci|torna|voltar?|volte|keer|ga|пожалуйста|вернитесь)(?!\w)"
)
# Notices that leave no doubt: they address the reader, or end with what is required.
ASKING = re.compile(rf"^\W*(?:sorry,? )?(?:please|you (?:need|must|have|will need) |turn |enable |bitte|por favor|veuillez|per favore|пожалуйста)|(?:requires?|needs?|benötigt|requiere|necesita|nécessite|richiede|requer|vereist|требует\w*) (?:{_SCRIPT})\W*$")
LOADING = re.compile(r"\s*(?:loading|wird geladen|cargando|chargement|caricamento|carregando|laden|загрузка)(?: \S+){0,5}?[.…\s]*$")
# What a notice or an order is about ("the ... requires", "reload the ..."): three words at most, whatever they are.
OBJECT = re.compile(r"(?<!\w)(?:the|this|your|our|a|an|die|der|das|diese|el|la|este|esta|le|cette|ce|il|questo|o|de|deze) ((?:[^\W\d_]+ ?){1,3}?)(?= ?(?:requires?|needs?|works?|runs?|doesn't|does|cannot|can't|is|has|was|must|will|should|to|zu|para|pour|per|om|stays|in|on)(?!\w)|[.…!?,]|\s*$)")
CHECK = re.compile(rf"(?<!\w)(?:{_CHECK})(?!\w)")
FAILS = [re.compile(rf"(?<!\w)(?:{_FAILURE[k]})(?!\w)") for k in _FAILURE]
SUBJECTS = [re.compile(rf"(?<!\w)(?:{_SUBJECT[k]})(?!\w)") for k in _FAILURE]
ASIAN_END = re.compile(ASIAN_COURTESY)

# Literals one of which stands in any message; the automaton looks for them.
ANCHORS = sorted(
    {
        *ASIAN_MESSAGES,
        *REASON_LIST,
        *"javascript; java script; scripts; script; scripting; cookie; skript; js; скрипт; スクリプト; クッキー; 脚本; 자바스크립트; 쿠키".split("; "),
        *"sorry; cannot ; err_; login; sign; log in; security; difficult; support; unterstützt; admite; ondersteunt; suporta; поддерживает; expir; berechtigung; novamente; opnieuw; whoops; oops; whoops; uh oh; uh-oh; browser; human; robot; captcha; security; redirect; automatic; moment; please wait; stand by; hold on; navegador; navigateur; patienter; warten; espere; aguarde; attendere; geduld; браузер; подождите; connection; ddos; ray id".split("; "),
        *"found; n't; not ; error; fehler; erreur; errore; erro; fout; ошибка; エラー; unavailable; denied; refused; expired; wrong; broke; timed; timeout; time-out; too long; too many; limit; blocked; moved; removed; deleted; maintenance".split("; "),
        *"no such; no valid; invalid; unexpected; unable; busy; full; down; problem; try again; back; permission; suspended; longer; archived; cannot; offline; missing; nothing".split("; "),
        *"nicht; verweigert; gesperrt; abgelaufen; wartung; zu viele; später; existiert; ungültig; no ; denegado; caducado; expirado; mantenimiento; inténtelo; intente; de nuevo; introuvable; n'est; n'existe; indisponible".split("; "),
        *"refusé; expirée; interdit; produite; survenue; réessay; impossible; non ; impossibile; negato; scaduta; riprova; manutenzione; não; indisponível; negado; expirou; ocorreu; tente; niet; geweigerd; verlopen; probeer; onderhoud".split("; "),
        *"не ; недоступ; запрещ; истек; истёк; произошла; обслуживани; попробуйте; повторите".split("; "),
    }
)


PATTERNS = [REASON, CODE, BARE, NOTICE, SWITCH, CHECK, *FAILS, *SUBJECTS]


def covered(sentence: str) -> list[tuple[int, int]]:
    """Spans of a sentence that the patterns match, sorted."""
    return sorted(m.span() for p in PATTERNS for m in p.finditer(sentence))


def is_notice(sentence: str) -> bool:
    """Whether a sentence says that scripts or cookies must be switched on."""
    return bool(NOTICE.search(sentence) and SWITCH.search(sentence))


def is_message(sentence: str) -> bool:
    """Whether a sentence reports an error, asks for scripts or checks the browser."""
    if REASON.search(sentence) or CODE.search(sentence) or BARE.search(sentence) or CHECK.search(sentence):
        return True
    if any(p in sentence for p in ASIAN_MESSAGES):
        return True
    if is_notice(sentence):
        return True
    return any(f.search(sentence) and s.search(sentence) for f, s in zip(FAILS, SUBJECTS, strict=True))


# ---- filler and instructions: pattern, literals one of which any match contains, and whether it must be a whole
# line. Patterns hold within a line.

_THING = r"(?:text|texts|copy|content|contents|title|headline|heading|subtitle|name|description|summary|paragraph|sentence|caption|details|quote|image|logo|message|introduction|outcome|reason|information|data|value|body)"
FILLER = [
    (r"lorem ipsum(?=[ ,.:]*(?:dolor|sit|amet|lorem|[.!…:]?$))", ["lorem ipsum"], False),
    (rf"(?:this|here|these|that) (?:is|are)(?: just| only| some| a| an| the| your)* (?:placeholder|dummy|sample|example|filler|test|temporary)s?(?: {_THING})", ["this", "these", "here", "that"], False),
    (rf"(?:^|(?<=[.:!?\]\"»] )|(?<=: ))(?:a |some )?(?:placeholder|dummy|sample|filler|example) {_THING}\b(?=[.:!…]|$| (?:here|for|goes|only)\b)", ["placeholder", "dummy", "sample", "filler", "example"], False),
    (rf"\b{_THING} (?:goes|go|comes|will go|will appear|to go|to come) here\b", ["here"], False),
    (rf"\b(?:your|insert|enter|type|write|add|put|place|paste)(?: the| a| an| your| some| own| short| brief)* (?:\w+ )?{_THING} (?:here|below)\b", ["here", "below"], False),
    (rf"\breplace (?:this|me|it|the \w+|these)(?: {_THING})?(?: \w+)? (?:with|by) (?:the |your |an? )?(?:real|actual|own|final|correct|proper|appropriate)\b", ["replace"], False),
    (r"\bfor (?:layout|position|placement|placeholder|mock-?up|demo|demonstration) (?:purposes )?only\b", ["only"], False),
    (r"\bthe quick (?:\w+ ){1,4}(?:jump|hop|leap|run|skip|bound)(?:s|ed)? (?:over|across|past)\b", ["the quick"], False),
    (r"\bfoo bar (?:baz|foo bar)\b", ["foo bar"], False),
    (r"\b(?:blindtext|mustertext|fülltext|beispieltext|platzhaltertext|typoblindtext)(?: (?:blindtext|mustertext)|[.:!]|$)", ["text"], False),
    (r"\b(?:dies|das|hier) ist (?:nur )?(?:ein|der) (?:platzhalter\w*|blindtext|beispieltext|mustertext|fülltext)", ["ist "], False),
    (r"\bhier (?:steht|kommt|folgt)(?: \w+){0,3} (?:text|inhalt|titel|beschreibung)\b", ["hier "], False),
    (r"\btexto (?:de |)(?:relleno|ejemplo|muestra|prueba|exemplo|preenchimento|fictício|provisório|simulado)(?=[.:!]|$| aqu)", ["texto"], False),
    (r"\b(?:aquí|aqui) (?:va|vai|irá|iría)(?: \w+)? (?:texto|descripción|descrição|título|contenido|conteúdo|nombre|nome)\b", ["aqu"], False),
    (r"\b(?:texte (?:de remplissage|d'exemple|factice|provisoire|fictif|à remplacer)|faux[- ]texte)\b|\b(?:votre|insérez (?:votre|le)) texte ici\b", ["text"], False),
    (r"\b(?:testo (?:segnaposto|di esempio|fittizio|riempitivo|di prova|provvisorio))\b|\b(?:il tuo testo|inserisci (?:il )?testo) qui\b", ["testo"], False),
    (r"\b(?:seu texto|insira (?:o |seu )?texto) aqui\b", ["texto"], False),
    (r"\b(?:voorbeeldtekst|opvultekst|plaatshoudertekst|dummytekst)\b|\b(?:uw|jouw) tekst hier\b", ["tekst"], False),
    (r"текст-?заполнитель|рыб[ан]\w* текст|ваш текст здесь|пример текста|здесь будет (?:ваш )?(?:текст|описание|заголовок)", ["текст", "здесь будет"], False),
    (r"(?:サンプル|ダミー|仮|例)の?(?:テキスト|文章|文言|本文)(?:です|。|が入ります|$)", ["テキスト", "文章", "文言", "本文"], False),
    (r"(?:この|これ)[^。]{0,12}(?:ダミー|サンプル|仮のもの)(?:です|である|テキスト)", ["ダミー", "サンプル", "仮の"], False),
    (r"(?:ここ|こちら)に[^。「」]{0,16}(?:入ります|入る|入力|記入|記載|挿入)", ["ここに", "こちらに"], False),
    (r"(?:文|文章|本文|テキスト|説明|説明文|内容|タイトル|概要|名前)を?(?:ご?入力|ご?記入|記載)(?:して)?(?:ください|下さい)", ["入力", "記入", "記載"], False),
    (r"(?:占位|示例|测试|範例|填充)(?:文本|文字|内容)|(?:在)?此[处處](?:输入|填写|輸入|填寫|插入)", ["文本", "文字", "内容", "此处", "此處"], False),
]
INSTRUCTIONS = [
    (rf"(?:please )?(?:add|write|enter|insert|type|describe|provide|give|fill in|summari[sz]e|state|put)(?: in)?(?: a| an| the| your| some| one| this| our)?(?: short| brief| concise| detailed| one-line| few| \w+ to \w+)*(?: \w+)? {_THING}(?: of \w+(?: \w+)?)?(?: here| below)?", ["add", "write", "enter", "insert", "type", "describe", "provide", "give", "fill in", "summari", "state", "put"], True),
    (r"(?:click|tap|double[- ]click|press)(?: here)? to (?:edit|add|enter|insert|change|write|type)(?: \w+){0,3}", ["click", "tap", "press"], True),
    (r"(?:n/?a|tbd|tba|tbc|todo|open)? ?[-–—:]? ?(?:still )?to (?:be|get) (?:written|completed|filled(?: in| out)?|determined|added|defined|supplied|announced|decided|done|described|confirmed)", ["to be ", "to get "], True),
    (r"\[(?:please )?(?:write|type|insert|enter|add|describe|fill(?: in)?|your|put|provide|replace|edit|text|content|name)\b[^\[\]]*\]", ["[write", "[type", "[insert", "[enter", "[add", "[describe", "[fill", "[your", "[put", "[provide", "[replace", "[edit", "[text", "[content", "[name", "[please"], True),
    (r"(?:bitte )?(?:hier )?(?:\w+ ){0,2}(?:text|inhalt|titel|beschreibung|zusammenfassung|name|namen|angaben)(?: hier)? (?:eingeben|einfügen|ergänzen|eintragen|ausfüllen)", ["eingeben", "einfügen", "ergänzen", "eintragen", "ausfüllen"], True),
    (r"(?:por favor,? )?(?:escrib[ae]|ingres[ae]|insert[ae]|añad[ae]|agregu?[ea]|introduzca|describa|escreva|insira|adicione|digite|descreva)(?: \w+){0,4}(?: aquí| aqui| texto| descripción| resumen| título| descrição| resumo)", ["escrib", "ingres", "insert", "añad", "agreg", "introduzca", "describa", "escreva", "insira", "adicione", "digite", "descreva"], True),
    (r"(?:veuillez )?(?:saisi\w+|écri\w+|insér\w+|ajout\w+|entr\w+|décri\w+)(?: \w+){0,4}(?: ici| texte| description| résumé| titre)", ["ici", "texte", "description", "résumé", "titre"], True),
    (r"(?:inserire|inserisci|scrivere|scrivi|aggiungi|descrivi)(?: \w+){0,4}(?: qui| testo| descrizione| titolo)", ["qui", "testo", "descrizione", "titolo"], True),
    (r"(?:voer|typ|schrijf|vul)(?: \w+){0,4}(?: hier| tekst| titel)(?: in)?", ["hier", "tekst", "titel"], True),
    (r"(?:введите|напишите|вставьте|добавьте|опишите)(?: \w+){0,4}", ["введите", "напишите", "вставьте", "добавьте", "опишите"], True),
]
PROMPTS = [("filler", re.compile(p), anchors, whole) for p, anchors, whole in FILLER] + [("instruction", re.compile(p), anchors, whole) for p, anchors, whole in INSTRUCTIONS]
