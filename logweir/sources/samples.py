"""A few lines of every source, of our own making, for the self test before a run."""

SAMPLES: dict[str, tuple[str, ...]] = {
    "cisco_asa": (
        "<165>Mar 7 04:31:18 edge-lisbon %ASA-5-302014: Teardown TCP connection 5521 for inside:192.0.2.77/41200 to lab:198.51.100.3/8443 duration 1:02:03 bytes 90210 Reset (mira)",
        "<164>Mar 17 23:00:01 edge-oslo %ASA-4-106023: Deny udp src inside:192.0.2.9/5353 dst lab:203.0.113.5/53 by access-group \"lab_in\" [0x0, 0x0]",
        "<166>Mar 2 00:00:59 edge-lisbon %ASA-6-111008: User 'noor' executed the 'write' command",
    ),
    "proxy_access": (
        '192.0.2.14 - ATELIER\\noor [07/Mar/2023:04:31:18 +0000] "CONNECT files.example.net:443 HTTP/1.1" 200 512 "-" "loom/3" "cs_bytes=80 sc_bytes=512 proxy_action=tunnel tunnel_duration_ms=1500"',
        '192.0.2.15 - - [07/Mar/2023:04:31:19 +0000] "GET http://maps.example.net/tile?z=3 HTTP/1.1" 403 0 "-" "loom/3"',
    ),
    "snort_alert": (
        "03/07-04:31:18.250000 [**] [1:40117:2] PROBE unusual greeting [**] [Classification: Misc activity] [Priority: 3] {TCP} 203.0.113.8:55000 -> 192.0.2.80:25",
        "03/07-04:31:19.000001 [**] [119:4:1] PROBE long header [**] [Priority: 2] {ICMP} 203.0.113.8 -> 192.0.2.80",
    ),
    "syslog": (
        "<38>1 2023-03-07T04:31:18.5Z loom-7 sshd 812 - - Accepted publickey for mira from 203.0.113.90 port 50022 ssh2",
        "<13>1 2023-03-07T04:31:19Z loom-7 planner - - - plan 17 written",
    ),
    "web_access": (
        '203.0.113.4 - mira [07/Mar/2023:04:31:18 +0000] "PUT /seeds/17?draft=1 HTTP/1.1" 201 64 "https://garden.example/new" "spade/1.4"',
        '203.0.113.4 - - [07/Mar/2023:04:31:20 +0000] "GET /seeds HTTP/1.0" 304 - "-" "spade/1.4"',
    ),
    "zeek_conn": (
        '{"ts":1678163478.5,"id.orig_h":"192.0.2.31","id.orig_p":50100,"id.resp_h":"2001:db8::53","id.resp_p":53,"proto":"udp","conn_state":"SF","orig_bytes":60,"resp_bytes":120}',
    ),
    "zeek_dns": (
        '{"ts":1678163478.6,"id.orig_h":"192.0.2.31","id.orig_p":50101,"id.resp_h":"192.0.2.53","id.resp_p":53,"proto":"udp","query":"garden.example","rcode_name":"NOERROR","answers":["198.51.100.20"],"TTLs":[30.0]}',
    ),
    "zeek_http": (
        '{"ts":1678163478.7,"id.orig_h":"192.0.2.31","id.orig_p":50102,"id.resp_h":"198.51.100.20","id.resp_p":80,"method":"GET","host":"garden.example","uri":"/seeds?season=spring","status_code":200}',
    ),
}
